"""Exact dedup through counting quotient filters.

Each partition builds one counting quotient filter per range of quotients
over 64-bit fingerprints of its normalised texts.  A filter stores a
fingerprint losslessly as quotient (its place) and remainder, so filters of a
range merge by their sorted remainders, counts added.  Only fingerprints whose
merged count exceeds one can belong to copies: their texts are compared byte
by byte, as grouping keys.  A copy costs one filter entry per partition, and
equal texts meet as one partial row per task, so a large group of copies is
never gathered in one place.

Defined results: null counts as the empty text; texts that differ only in
white space are equal; of equal texts the one with most code points stays,
then the smallest id (a null id last).  Rows that agree in id, length and
normalised text count as copies and stay or go together.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bucket_count, store

WHITE = r"[\x20\x09-\x0D]+"


class CountingQuotientFilter:
    """A counting quotient filter in compact form.

    ``occupied`` marks quotients that have a run, ``run_end`` the last entry
    of each run; remainders are sorted within a run and each has a count."""

    def __init__(self, bits: int, occupied: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.occupied, self.run_end = bits, occupied, run_end
        self.remainders, self.counts = remainders, counts

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray | None = None, width: int = 64, load: float = 0.75):
        """From fingerprints below 2**width, with counts if they have any yet."""
        counts = np.ones(len(prints), np.int64) if counts is None else counts
        values, inverse = np.unique(prints.astype(np.uint64), return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, inverse, counts)
        bits = min(width, max(1, int(np.ceil(np.log2(max(2, len(values) / load))))))
        low = np.uint64(width - bits)
        quotient = (values >> low).astype(np.int64)
        occupied = np.zeros(1 << bits, bool)
        occupied[quotient] = True
        run_end = np.append(quotient[1:] != quotient[:-1], True) if len(values) else np.zeros(0, bool)
        remainder = values & ((np.uint64(1) << low) - np.uint64(1)) if low else np.zeros(len(values), np.uint64)
        return cls(bits, np.packbits(occupied), run_end, remainder, total)

    def entries(self, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in ascending order, with their counts."""
        places = np.flatnonzero(np.unpackbits(self.occupied)[:1 << self.bits]).astype(np.uint64)
        run = np.concatenate(([0], np.cumsum(self.run_end)[:-1])).astype(np.int64) if len(self.run_end) else np.zeros(0, np.int64)
        low = np.uint64(width - self.bits)
        return (places[run] << low | self.remainders) if len(run) else np.zeros(0, np.uint64), self.counts

    def count(self, fingerprint: int, width: int = 64) -> int:
        low = width - self.bits
        place, rest = fingerprint >> low, fingerprint & ((1 << low) - 1)
        marks = np.unpackbits(self.occupied)[:1 << self.bits]
        if not marks[place]:
            return 0
        ends = np.flatnonzero(self.run_end)
        run = int(marks[:place].sum())
        first = int(ends[run - 1]) + 1 if run else 0
        at = first + int(np.searchsorted(self.remainders[first:ends[run] + 1], np.uint64(rest)))
        return int(self.counts[at]) if at <= ends[run] and int(self.remainders[at]) == rest else 0

    def merge(self, other: "CountingQuotientFilter", width: int = 64) -> "CountingQuotientFilter":
        a, b = self.entries(width), other.entries(width)
        return type(self).build(np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])), width)

    def dump(self) -> bytes:
        head = np.array([self.bits, len(self.remainders), len(self.occupied)], "<i8").tobytes()
        return b"".join((head, self.occupied.tobytes(), np.packbits(self.run_end).tobytes(),
                         self.remainders.astype("<u8").tobytes(), self.counts.astype("<i8").tobytes()))

    @classmethod
    def load(cls, data: bytes) -> "CountingQuotientFilter":
        bits, n, m = np.frombuffer(data, "<i8", 3).tolist()
        at, k = 24 + m, (n + 7) // 8
        return cls(bits, np.frombuffer(data, np.uint8, m, 24),
                   np.unpackbits(np.frombuffer(data, np.uint8, k, at))[:n].astype(bool),
                   np.frombuffer(data, "<u8", n, at + k), np.frombuffer(data, "<i8", n, at + k + 8 * n))


def repeated_fingerprints(prints: DataFrame, ranges: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once in ``prints.fp``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            values = np.concatenate(held).view(np.uint64)
            place = ((values >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)  # ranges of quotients
            order = np.argsort(place, kind="stable")
            values, place = values[order], place[order]
            cuts = np.flatnonzero(np.diff(place)) + 1
            rows = [(int(p[0]), CountingQuotientFilter.build(v).dump())
                    for p, v in zip(np.split(place, cuts), np.split(values, cuts))]
            return pa.RecordBatch.from_pydict({"range": pa.array([r[0] for r in rows], pa.int32()),
                                               "cqf": pa.array([r[1] for r in rows], pa.binary())})

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += len(held[-1])
            if n >= 1 << 22:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        filters = [CountingQuotientFilter.load(x.as_py()) for x in group.column("cqf")]
        while len(filters) > 1:  # in pairs, so that each entry is merged a logarithmic number of times
            filters = [a.merge(b) for a, b in zip(filters[::2], filters[1::2])] + filters[len(filters) & ~1:]
        prints_, counts = filters[0].entries()
        more = counts > 1
        return pa.table({"fp": pa.array(prints_[more].view(np.int64), pa.int64()), "n": pa.array(counts[more], pa.int64())})

    return (prints.select("fp").mapInArrow(build, "range int, cqf binary")
            .groupBy("range").applyInArrow(merge, "fp long, n long"))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), F.length(text).cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    prints = base.withColumn("fp", F.xxhash64("norm"))
    digests = store(prints.select("doc_id", "n_chars", "fp", F.sha2("norm", 256).alias("text_sha256")), "digests")
    repeated = store(repeated_fingerprints(digests, bucket_count(digests)), "repeated")
    # byte verification: the normalised text itself is the grouping key
    first = F.min(F.struct((-F.col("n_chars")).alias("m"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id")))
    classes = (prints.join(repeated.select("fp"), "fp", "left_semi").groupBy("fp", "norm")
               .agg(first.alias("keep"), F.count(F.lit(1)).alias("group_size"))
               .select("fp", F.sha2("norm", 256).alias("text_sha256"), F.col("keep.id").alias("keep_id"),
                       (-F.col("keep.m")).alias("keep_chars"), "group_size"))
    out = digests.join(classes, ["fp", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))).alias("kept"),
        "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns as they are.  Rows with the
    same doc_id stay if one of them does."""
    stay = groups(docs).where("kept").select(F.col("doc_id").alias("__stay")).distinct()
    return docs.alias("d").join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.__stay")), "left_semi")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
           FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d
      WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
