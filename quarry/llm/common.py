"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-llm/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the
    lineage ends there, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _size(text: str) -> int:
    text = text.strip().lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def bucket_count(scan: DataFrame, target_bytes: int = 8 << 20, least: int = 64) -> int:
    """How many hash buckets keep one bucket near ``target_bytes``: from the
    splits of a plain scan, so it grows with the table and runs no job."""
    split = _size(scan.sparkSession.conf.get("spark.sql.files.maxPartitionBytes"))
    return max(least, scan.rdd.getNumPartitions() * split // target_bytes)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets, without Python
    strings; a null row has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, starts, data = column.buffers()
    n = len(column)
    offsets = (np.frombuffer(starts, np.int64)[column.offset:column.offset + n + 1]
               if n else np.zeros(1, np.int64))
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may keep bytes behind it
        keep = column.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(keep, np.diff(offsets), 0)
        if (lengths != np.diff(offsets)).any():
            return utf8(column.fill_null(""))
    return raw, offsets


def slices(offsets: np.ndarray, target: int = 1 << 20):
    """Row ranges of about ``target`` bytes each; one longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ids_of(column: pa.Array) -> np.ndarray:
    """A bigint column as int64, and its nulls as the smallest value."""
    if column.null_count:
        column = column.fill_null(-(1 << 63))
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Polynomial hashes, modulo 2**64, of any window of a byte string."""

    def __init__(self, base: int):
        self.base = base | 1
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums to be passed to ``window``."""
        n = len(data) + 1
        if n > len(self.up):
            size = max(n, 1 << 20)
            for name, value in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(size, value, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        out = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n - 1], out=out[1:])
        return out

    def window(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]
