"""Ids of the ``tokenizers`` library for whole texts."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import regex

from quarry.llm import vocabulary
from quarry.llm.tokens import ChunkCache


@functools.cache
def encoder(path: str, added: bool = False) -> Callable[[str], bytes]:
    """One per Python worker: ids of a pre-token by the library's BPE model.

    The pre-token's bytes are written as the vocabulary's characters, which
    is the library's byte-level pre-tokenizer.  The file's added tokens are
    ordinary text, or with ``added`` have their ids, as in the library's
    ``encode`` unless ``encode_special_tokens`` is set."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize = tokenizer.model.tokenize
    written = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]
    mapped = vocabulary.mapper()

    def encode(piece: str) -> bytes:
        return b"".join([written[t.id] for t in tokenize(mapped(piece))])

    cache = ChunkCache(encode)
    return _with_added(tokenizer, cache) if added else cache


def _with_added(tokenizer, cache: ChunkCache) -> Callable[[str], bytes]:
    """Texts are cut at the added tokens, of which the first and then the
    longest counts; what is between them is encoded alone."""
    tokens = tokenizer.get_added_tokens_decoder()
    ids = {t.content: i.to_bytes(4, "little") for i, t in tokens.items()}
    if not ids:
        return cache
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(ids, key=len, reverse=True))) + ")")
    plain = tokenizer.normalizer is None and not any(t.single_word or t.lstrip or t.rstrip for t in tokens.values())

    def encode(text: str) -> bytes:
        if not plain:  # tokens that take more than their own characters
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not any(token in text for token in ids):
            return cache(text)
        return b"".join([ids[part] if k % 2 else cache(part) for k, part in enumerate(cut.split(text))])

    return encode
