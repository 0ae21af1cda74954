"""Ids of a ``tokenizers`` file whose pre-tokens never hold white space.

Such a tokenizer gives the same ids whether it reads a text whole or cut at
spaces and line ends, so a chunk between them is encoded once and its ids are
kept as bytes.  Added tokens have their ids, as in the library as loaded.
"""

from __future__ import annotations

import functools
import os
import string
import unicodedata
from collections.abc import Callable

import numpy as np

from quarry.llm import vocabulary


class WordCache(dict):
    """chunk -> ids as little-endian unsigned 32-bit integers; when ``limit``
    chunks are held they go.

    Most chunks are a word and a run of marks after it.  The word, normalised,
    and the run are a pre-token each, and the ids of pre-tokens are kept as well:
    a word costs the model's work once, however it is written.  All other
    chunks are read by the library itself."""

    def __init__(self, tokenizer, limit: int = 400_000):
        super().__init__()
        self.read = functools.partial(tokenizer.encode, add_special_tokens=False)
        self.tokenize, self.mapped = tokenizer.model.tokenize, vocabulary.mapper()
        self.limit, self.pieces = limit, {}
        self.written = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, chunk: str) -> bytes:
        body = chunk.rstrip(string.punctuation)
        word = self._word(body)
        if not chunk:
            ids = b""
        elif word is None:
            ids = np.array(self.read(chunk).ids, "<u4").tobytes()
        else:
            ids = self.piece(word) if word else b""
            if len(body) < len(chunk):
                ids += self.piece(chunk[len(body):])
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = ids
        return ids

    @staticmethod
    def _word(body: str) -> str | None:
        """The normalised word, if the chunk's body is one pre-token for sure:
        letters of alphabets that Python and the library lower alike."""
        if body.isascii():
            return body.lower() if body.isalpha() or not body else None
        if body.isalpha() and max(body) < "\u0530" and "\u03a3" not in body and unicodedata.is_normalized("NFC", body):
            low = body.lower()
            return low if low.isalpha() and unicodedata.is_normalized("NFC", low) else None
        return None

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = b"".join([self.written[t.id] for t in self.tokenize(self.mapped(piece))])
            if len(self.pieces) >= self.limit:
                self.pieces.clear()
            if len(piece) <= 64:
                self.pieces[piece] = ids
        return ids


@functools.cache
def encoder(path: str) -> Callable[[str], bytes]:
    """One per Python worker: ids of a whole text as little-endian unsigned
    32-bit integers."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    known = WordCache(Tokenizer.from_file(path))

    def encode(text: str) -> bytes:
        return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" ")))

    return encode
