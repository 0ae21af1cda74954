"""Token ids in files of directly addressable codes.

An id is split into chunks of ``CHUNK`` bits.  Level 0 holds the lowest chunk
of every id; a bitmap marks the ids that go on, and level 1 holds the next
chunk of those alone, and so on.  A rank directory over each bitmap says how
many ids before a position go on, so the chunks of any id are found by one
look-up per level, without decoding a block.

The files are Parquet with a binary column, one segment per row: Spark's own
writer commits them, and any store that Spark reads will do.  Texts are dealt
by ranges of doc_id and sorted, so segments follow one another in ascending
doc_id order; a segment closes when ``SEGMENT`` ids are full, between documents.

Defined results: null and empty texts are one end token; a null id comes
first; rows of one id stand side by side in the order of their texts; other
columns are ignored, whatever their names; an empty table has no files' rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import vocabulary
from quarry.llm.common import ids_of, shared_path
from quarry.llm.tokenized import encoder

CHUNK = 8
SEGMENT = 1 << 20
WORD = 64  # positions per word of a bitmap and entry of its rank directory
END = b"\0\0\0\0"


class DirectCodes:
    """Ids of one segment as chunk levels with continuation bitmaps."""

    def __init__(self, n: int, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.n, self.levels = n, levels

    @classmethod
    def build(cls, ids: np.ndarray) -> "DirectCodes":
        levels, rest, n = [], ids.astype(np.uint32), len(ids)
        while True:
            more = rest >> np.uint32(CHUNK) != 0
            padded = np.zeros(-(-len(more) // WORD) * WORD, bool)
            padded[:len(more)] = more
            bitmap = np.packbits(padded, bitorder="little").view("<u8")
            ranks = np.cumsum(np.bitwise_count(bitmap), dtype=np.int64) - np.bitwise_count(bitmap)
            levels.append(((rest & np.uint32((1 << CHUNK) - 1)).astype(np.uint8), bitmap, ranks.astype("<u4")))
            rest = rest[more] >> np.uint32(CHUNK)
            if not len(rest):
                return cls(n, levels)

    def dump(self) -> bytes:
        out = [np.array([self.n, len(self.levels)], "<i8").tobytes()]
        for chunks, bitmap, ranks in self.levels:
            out += [np.array([len(chunks), len(bitmap)], "<i8").tobytes(), chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, data: bytes) -> "DirectCodes":
        n, depth = np.frombuffer(data, "<i8", 2).tolist()
        at, levels = 16, []
        for _ in range(depth):
            a, b = np.frombuffer(data, "<i8", 2, at).tolist()
            at += 16
            levels.append((np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, "<u8", b, at + a),
                           np.frombuffer(data, "<u4", b, at + a + 8 * b)))
            at += a + 12 * b
        return cls(n, levels)

    def get(self, positions: np.ndarray) -> np.ndarray:
        """Ids at any positions, level by level through the directories."""
        at = np.asarray(positions, np.int64)
        out, open_ = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bitmap, ranks) in enumerate(self.levels):
            out[open_] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK * level)
            word, bit = bitmap[at // WORD], (at % WORD).astype(np.uint64)
            more = word >> bit & np.uint64(1) != 0
            at, word, bit, open_ = at[more], word[more], bit[more], open_[more]
            if not len(at):
                break
            at = ranks[at // WORD].astype(np.int64) + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return out


def write(docs: DataFrame, target: str, path: str | None = None, added: bool = False) -> None:
    """Write the files: part, seg, base (ids of the same part before it),
    n_ids, doc_ids and ends (documents of the segment), codes."""
    path = path or vocabulary.path(vocabulary.BYTE_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, added), TaskContext.get().partitionId()
        held, ids, state = [], [], {"n": 0, "seg": 0, "base": 0}

        def flush():
            data = np.frombuffer(b"".join(ids), "<u4")
            ends = np.cumsum([len(x) // 4 for x in ids])
            row = {"part": [part], "seg": [state["seg"]], "base": [state["base"]], "n_ids": [len(data)],
                   "doc_ids": [held[:]], "ends": [ends.tolist()], "codes": [DirectCodes.build(data).dump()]}
            state.update(n=0, seg=state["seg"] + 1, base=state["base"] + len(data))
            held.clear(), ids.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([
                ("part", pa.int32()), ("seg", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()),
                ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("codes", pa.binary())]))

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                few = batch.slice(at, 1000)
                for doc, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist()):
                    held.append(doc)
                    ids.append(encode(text or "") + END)
                    state["n"] += len(ids[-1]) // 4
                    if state["n"] >= SEGMENT:
                        yield flush()
        if held:
            yield flush()

    parts = max(1, docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id")
     .sortWithinPartitions("doc_id", "text")
     .mapInArrow(run, "part int, seg int, base long, n_ids long, doc_ids array<long>, ends array<long>, codes binary")
     .write.parquet(target))


def read(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, by random
    access to its ids in the files."""
    files = spark.read.parquet(target)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per part
    first = totals.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                codes = DirectCodes.load(row.column("codes")[0].as_py())
                ends = np.array(row.column("ends")[0].as_py(), np.int64)
                starts = np.concatenate(([0], ends[:-1]))
                base = row.column("start")[0].as_py()
                crc = []
                for i in range(0, len(ends), 64):  # some documents at a time
                    a, b = starts[i], ends[min(i + 64, len(ends)) - 1]
                    data = codes.get(np.arange(a, b)).astype("<u4")
                    crc += [zlib.crc32(data[x - a:y - a].tobytes()) for x, y in zip(starts[i:i + 64], ends[i:i + 64])]
                yield pa.RecordBatch.from_arrays(
                    [row.column("doc_ids")[0].values, pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(first), "part").select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "ends", "codes")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, added: bool = False) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    target = shared_path(docs.sparkSession, "tokens")
    write(docs, target, path, added)
    return read(docs.sparkSession, target)
