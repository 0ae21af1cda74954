"""Vector bin packing of training examples by the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.
It is filled by taking, again and again, the example with the largest dot
product of its demands and what is left of the limits, each dimension weighted
by its total demand, among the examples that fit in all three.  Examples with
equal demands are one class, so a step looks at classes and not at examples.

Each task packs the rows of its own split as they are read, from a pool of
bounded size: nothing is shuffled, no count is gathered and no executor holds
more than the pool.  Sequence numbers come from the partition number.

Documents may be cut.  When nothing fits what is left of a sequence, the
longest document is cut to fill it, and its tail goes back to the pool.  A
sequence that still cannot be filled is cut down to a power of two, which needs
no padding; so only the last few sequences of a task are short.

Defined results: null and empty texts are one end token; repeated rows are
packed each; equal demands take places in reading order; a null id stays null;
other columns are ignored, whatever their names; an empty table has no
sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm import vocabulary, word_tokens

WORD_BPE = "word_bpe_49k.json"
END = b"\2\0\0\0"


class Limits(NamedTuple):
    """Of one sequence."""

    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096


class Piece(NamedTuple):
    item: Any
    start: int
    length: int
    loss: int


class Packer:
    """A pool of pieces, and sequences made from it.

    With ``cut`` every token of a piece must bear loss, so that a part of a
    piece has a known demand."""

    def __init__(self, limits: Limits = Limits(), cut: bool = True):
        self.limits, self.cut = limits, cut
        self.held: dict[tuple[int, int], list[Piece]] = {}
        self.place: dict[tuple[int, int], int] = {}
        self.demand = np.zeros((0, 3))  # of each class: tokens, segments, loss
        self.free = np.zeros(0, np.int64)  # pieces of each class
        self.tokens = self.pieces = 0

    def add(self, piece: Piece) -> None:
        key = (piece.length, piece.loss)
        if key not in self.place:
            self.place[key] = len(self.free)
            self.demand = np.vstack([self.demand, [piece.length, 1, piece.loss]])
            self.free = np.append(self.free, 0)
            self.held[key] = []
        self.held[key].append(piece)
        self.free[self.place[key]] += 1
        self.tokens += piece.length
        self.pieces += 1

    def _take(self, at: int) -> Piece:
        key = (int(self.demand[at, 0]), int(self.demand[at, 2]))
        self.free[at] -= 1
        self.tokens -= key[0]
        self.pieces -= 1
        return self.held[key].pop()

    def _forget_empty(self) -> None:
        keys = [k for k, pieces in self.held.items() if pieces]
        at = [self.place[k] for k in keys]
        self.demand, self.free = self.demand[at], self.free[at]
        self.held = {k: self.held[k][::-1] for k in keys}  # taken from the end
        self.place = {k: i for i, k in enumerate(keys)}

    def sequences(self, least: int = 0) -> Iterator[list[Piece]]:
        """Fill sequences until fewer than ``least`` tokens are in the pool
        (all of it, without ``least``)."""
        if not self.pieces or self.tokens < least:
            return
        self._forget_empty()
        full = np.array(self.limits, float)
        weight = self.demand.T @ self.free / full / full / full  # total demand, and both factors in parts of the limit
        while self.pieces and self.tokens >= least:
            yield self._sequence(full, weight)
        self.held = {k: pieces[::-1] for k, pieces in self.held.items()}

    def _sequence(self, full: np.ndarray, weight: np.ndarray) -> list[Piece]:
        left, out = full.copy(), []
        while left[0] and left[1]:
            fits = (self.free > 0) & (self.demand <= left).all(axis=1)
            if fits.any():
                at = int(np.where(fits, self.demand @ (weight * left), -1).argmax())
                piece = self._take(at)
            elif self.cut and self.pieces and left.min() > 0:
                room = int(min(left[0], left[2]))
                at = int(np.where(self.free > 0, self.demand[:, 0], -1).argmax())
                piece = self._split(self._take(at), room)
            else:
                break
            out.append(piece)
            left -= (piece.length, 1, piece.loss)
        if not out:  # an example above a limit has a sequence to itself
            out.append(self._take(int(np.flatnonzero(self.free > 0)[0])))
        return self._level(out) if self.cut else out

    def _split(self, piece: Piece, room: int) -> Piece:
        """The head of ``room`` tokens; the tail goes back."""
        self.add(Piece(piece.item, piece.start + room, piece.length - room, piece.loss - room))
        return Piece(piece.item, piece.start, room, room)

    def _level(self, pieces: list[Piece]) -> list[Piece]:
        """Cut down to a power of two, if neither that nor full."""
        total = sum(p.length for p in pieces)
        over = 0 if total == self.limits.tokens else total - (1 << total.bit_length() - 1)
        while over:
            last = pieces.pop()
            if last.length > over:
                pieces.append(self._split(last, last.length - over))
                break
            over -= last.length
            self.add(last)
        return pieces


def pack(docs: DataFrame, path: str | None = None, limits: Limits = Limits(), pool: int = 1 << 21,
         with_ids: bool = False) -> DataFrame:
    """Documents as pieces in sequences: ids of the text and an end token, all
    of which bear loss.  ``pool`` tokens at most wait for a sequence."""
    path = path or vocabulary.path(WORD_BPE)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + (", ids binary" if with_ids else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, out = word_tokens.encoder(path), Packer(limits), _Rows(kind_of, with_ids)
        cap = min(limits.tokens, limits.loss)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                for doc_id, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist()):
                    ids = encode(text or "") + END
                    n, start = len(ids) // 4, 0
                    item = (doc_id, ids, n)
                    while n - start >= cap:  # full by itself
                        out.sequence([Piece(item, start, cap, cap)])
                        start += cap
                    if start < n:
                        packer.add(Piece(item, start, n - start, n - start))
                if packer.tokens >= pool:
                    for pieces in packer.sequences(pool // 2):
                        out.sequence(pieces)
                yield from out.full()
        for pieces in packer.sequences():
            out.sequence(pieces)
            yield from out.full()
        yield from out.full(last=True)

    kind_of = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class _Rows:
    """Pieces in sequences, as record batches."""

    def __init__(self, kind: pa.DataType, with_ids: bool):
        self.kind, self.with_ids, self.rows = kind, with_ids, []
        self.next = TaskContext.get().partitionId() << 33

    def sequence(self, pieces: list[Piece]) -> None:
        at = 0
        for (doc_id, ids, n), start, length, _ in pieces:
            part = ids[4 * start:4 * (start + length)]
            self.rows.append((doc_id, start, length, zlib.crc32(part), n, self.next, at) + ((part,) if self.with_ids else ()))
            at += length
        self.next += 1

    def full(self, last: bool = False, size: int = 10_000) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= size or last and self.rows:
            columns = list(zip(*self.rows))
            self.rows = []
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], self.kind), *(pa.array(c, pa.int64()) for c in columns[1:7]),
                 *(pa.array(c, pa.binary()) for c in columns[7:])], names[:len(columns)])


def pack_examples(examples: DataFrame, limits: Limits = Limits(), pool: int = 1 << 21) -> DataFrame:
    """Whole examples (id, tokens, loss) in sequences, nothing cut: adds
    ``sequence_id`` and ``offset``.  An example above a limit by itself has a
    sequence of its own and ``oversize`` set.  Null counts are 0."""
    kind = to_arrow_type(examples.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(limits, cut=False), TaskContext.get().partitionId() << 33

        def rows(sequences) -> Iterator[pa.RecordBatch]:
            nonlocal number
            out = []
            for pieces in sequences:
                at = 0
                for p in pieces:
                    over = p.length > limits.tokens or p.loss > limits.loss
                    out.append((p.item, p.length, p.loss, number, at, over))
                    at += p.length
                number += 1
            if out:
                types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 ["id", "tokens", "loss", "sequence_id", "offset", "oversize"])

        for batch in batches:
            for example, tokens, loss in zip(*(c.to_pylist() for c in batch.columns)):
                packer.add(Piece(example, 0, tokens, loss))
            if packer.tokens >= pool:
                yield from rows(packer.sequences(pool // 2))
        yield from rows(packer.sequences())

    counts = examples.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "loss")])
    return counts.mapInArrow(run, f"id {examples.schema['id'].dataType.simpleString()}, tokens long, loss long, "
                                  "sequence_id long, offset long, oversize boolean")


def conversation_examples(conversations: DataFrame, path: str | None = None, role: str = "assistant") -> DataFrame:
    """An example per conversation: its tokens with an end token after each
    turn, of which those of ``role`` bear loss."""
    path = path or vocabulary.path(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens.encoder(path)
        for batch in batches:
            n = [len(encode(t or "")) // 4 + 1 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("bears"), pa.array(n, pa.int64())],
                                             ["id", "bears", "n"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    turns = conversations.select(F.col("conv_id").alias("id"), F.coalesce(F.col("role") == role, F.lit(False)).alias("bears"), "text")
    return (turns.mapInArrow(run, f"id {kind}, bears boolean, n long").groupBy("id")
            .agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0)).alias("loss")))
