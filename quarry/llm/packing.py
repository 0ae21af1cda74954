"""Best-fit decreasing packing of token sequences.

Pieces are at most ``capacity`` tokens long, so there are at most
``capacity`` different lengths however many documents there are.  Best-fit
decreasing takes lengths in falling order and puts each piece in the tightest
open bin; pieces of one length that fall into bins of one remaining capacity
do so in runs, so the fold goes over (length, count) and keeps bins as
intervals of sequence numbers.  A segment tree over remaining capacities
finds the tightest open bin in logarithmic time.  The driver folds these
counts only; the piece that takes a place is found by its rank among the
pieces of its length, on the executors.

Defined results: null and empty texts are one end token; a longer document is
cut from its end, so the first piece may be shorter; pieces of equal length
take places in any order; repeated rows are packed each; other columns are
ignored, whatever their names; an empty table has no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import vocabulary
from quarry.llm.common import store
from quarry.llm.tokenized import encoder

CAPACITY = 2048
END = b"\0\0\0\0"


class CapacityTree:
    """Segment tree over remaining capacities 0..n: open bins at each."""

    def __init__(self, n: int):
        self.size = 1 << max(1, n).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of ``least`` or more that has an open bin."""
        at = least + self.size
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over (length -> count).

    Returns runs (length, first rank, pieces, first bin, pieces in a bin,
    offset of the first): pieces of a length by rank fill consecutive bins."""
    tree, held, runs, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            space = tree.tightest(length)
            if space is None:  # open as many bins as the rest needs
                space, each = capacity, capacity // length
                new = -(-left // each)
                held.setdefault(capacity, []).append((bins, new))
                tree.add(capacity, new)
                bins += new
            each = space // length
            first, n = held[space].pop()
            tree.add(space, -n)
            full = min(n, left // each)
            used = 0
            if full:
                runs.append((length, rank, full * each, first, each, capacity - space))
                _open(tree, held, space - each * length, first, full)
                rank, left, used = rank + full * each, left - full * each, full
            if left and used < n:  # one bin is filled in part
                runs.append((length, rank, left, first + used, left, capacity - space))
                _open(tree, held, space - left * length, first + used, 1)
                rank, left, used = rank + left, 0, used + 1
            if used < n:
                _open(tree, held, space, first + used, n - used)
    return runs


def _open(tree: CapacityTree, held: dict, space: int, first: int, n: int) -> None:
    held.setdefault(space, []).append((first, n))
    tree.add(space, n)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens, the end token
    included; ``added`` as in ``encoder``; ``part`` and ``rank`` number the pieces of a length within a
    task, in reading order."""
    path = path or vocabulary.path(vocabulary.BYTE_BPE)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(path, added), TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                few = batch.slice(at, 1000)
                rows, row_of = [], []
                for k, text in enumerate(few.column(1).to_pylist()):
                    ids = encode(text or "") + END
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rank = seen[b - a] = seen.get(b - a, -1) + 1
                        rows.append((piece, a, b - a, zlib.crc32(ids[4 * a:4 * b]), rank, ids[4 * a:4 * b]))
                        row_of.append(k)
                names = ["piece", "start", "length", "ids_crc32", "rank"]
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                columns = [few.column(0).take(pa.array(row_of, pa.int64())),
                           *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types)),
                           pa.array([part] * len(rows), pa.int32())]
                names = ["doc_id", *names, "part"]
                if with_ids:
                    columns.append(pa.array([r[5] for r in rows], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = (f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, rank long, part int"
              + (", ids binary" if with_ids else ""))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    cut = store(pieces(docs, path, capacity, with_ids, added), "pieces")
    held = store(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = plan(totals, capacity)
    by_length: dict[int, np.ndarray] = {}
    for r in runs:
        by_length.setdefault(r[0], []).append(r[1:])
    by_length = {k: np.array(v, np.int64) for k, v in by_length.items()}

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # bases grow with tasks x lengths: pieces (without texts) and bases are shuffled, nothing is broadcast
    ranked = (cut.join(bases.hint("merge"), ["length", "part"])
              .select(*[c for c in cut.columns if c not in ("rank", "part")], (F.col("base") + F.col("rank")).alias("rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                table = by_length[int(value)]
                run = table[np.searchsorted(table[:, 0], rank[rows], "right") - 1]
                within = rank[rows] - run[:, 0]
                sequence[rows] = run[:, 2] + within // run[:, 3]
                offset[rows] = run[:, 4] + within % run[:, 3] * value
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))
