"""Byte-level BPE through a sentencepiece model made from the vocabulary.

The model file is serialised directly: every token of a rank file becomes a
piece in its printable byte mapping, scored by its negative rank, under an
identity normaliser.  sentencepiece then merges the best-scored pair first,
which is the lowest rank.  Pre-tokens are encoded one by one; ids are decoded
by the inverse mapping of their pieces.

Defined results: null and empty texts have no ids; repeated rows get a row
each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import vocabulary
from quarry.llm.tokens import ChunkCache

UNKNOWN = "⁇"  # stands for no byte, so no text can reach it


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model.

    Field numbers are those of the public ``sentencepiece_model.proto``:
    pieces 1 (piece 1, score 2, type 3), trainer 2 (model type 3, ids of
    special pieces 40 to 43, unknown piece 45), normaliser 3 (name 1, dummy
    prefix 3, extra white space 4, escaped white space 5)."""
    chars = vocabulary.byte_chars()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode("utf-8")
        out.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    out.append(_field(1, _field(1, UNKNOWN.encode("utf-8")) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1 as a varint
    out.append(_field(2, _field(3, 2) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
                      + _field(45, UNKNOWN.encode("utf-8"))))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Codec:
    """Encodes texts to id bytes (little-endian 32-bit) and back."""

    def __init__(self, path: str):
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        mapped = vocabulary.mapper()
        back = {c: b for b, c in vocabulary.byte_chars().items()}
        self.bytes_of = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.tokens))]
        written = [i.to_bytes(4, "little") for i in range(len(self.tokens) + 1)]
        whole = dict(zip(self.tokens, written))

        merge = self.model.encode

        def encode(piece: str) -> bytes:
            raw = piece.encode("utf-8")
            if raw in whole:  # a pre-token that is a token needs no merges
                return whole[raw]
            return b"".join([written[i] for i in merge(mapped(piece))])

        self.encode = ChunkCache(encode)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def codec(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None, digests_only: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless
    ``digests_only``, ``ids`` (binary, little-endian 32-bit)."""
    path = path or vocabulary.path(vocabulary.MULTI_RANKS)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for text in part.column(1).to_pylist():
                    ids = use.encode(text or "")
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(use.decode(ids)).hexdigest(), ids))
                columns = [part.column(0), pa.array([r[0] for r in rows], pa.int64()),
                           pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if not digests_only:
                    columns.append(pa.array([r[3] for r in rows], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids binary")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
