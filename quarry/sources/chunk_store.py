"""Keyed store of chunks: hash buckets, copy on write, one manifest per version.

A row lies in the bucket of its key's hash.  A change rewrites the buckets that
hold one of its keys and no other; the files of all other buckets are listed by
the next manifest as they are.  Readers see one version throughout.

Defined results: a null key is an error; of several changes to one key the one
with the greatest order column wins, and without that column they are an error;
a row is replaced as a whole, so columns that a change does not have are null;
columns that the store does not have are added, with nulls in older rows;
changing or deleting nothing commits no version.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from quarry.operators.relational import latest_wins
from quarry.session import shared_table
from quarry.sources.manifest import Manifests

BUCKET, STATE = "_bucket", "_state"
KEPT, INSERTED, REPLACED = 0, 1, 2


class ChunkStore:
    """The store at ``path``; ``buckets`` counts when the store is made.  One
    bucket is the unit that is rewritten: choose their number so that it holds
    some 100 MB (``rebucket`` changes it)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", buckets: int = 16):
        self.spark, self.path, self.key, self._buckets = spark, path, key, buckets
        self.manifests = Manifests(spark, path)

    # ------------------------------------------------------------- reading
    def manifest(self, version: int | None = None) -> dict:
        return self.manifests.load(version) or {
            "version": 0, "key": self.key, "n_buckets": self._buckets, "schema": None, "buckets": {}}

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise FileNotFoundError(f"no store at {self.path}")
        return self._rows(m, sorted(m["buckets"], key=int)).drop(BUCKET)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the listed keys (first column of ``keys``); buckets
        without one of them are not read."""
        m = self.manifest()
        wanted = keys.select(F.col(keys.columns[0]).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        return self._rows(m, self._touched(wanted, m)).drop(BUCKET).join(wanted, self.key, "left_semi")

    def exists(self) -> bool:
        return self.manifests.load() is not None

    def count(self) -> int:
        """From the manifest; no file is read."""
        return sum(b["rows"] for b in self.manifest()["buckets"].values())

    def _schema(self, m: dict) -> StructType:
        return StructType.fromJson(m["schema"])

    def _rows(self, m: dict, buckets: list[str]) -> DataFrame:
        """Rows of some buckets, with their bucket."""
        schema = self._schema(m)
        held = [b for b in buckets if b in m["buckets"]]
        if not held:
            return self.spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0))
        by_commit: dict[str, list[str]] = {}
        for b in held:
            by_commit.setdefault(m["buckets"][b]["commit"], []).append(b)
        parts = [self.spark.read.schema(StructType(schema.fields).add(BUCKET, IntegerType())).option("basePath", self.manifests.folder(c))
                 .parquet(*[f"{self.manifests.folder(c)}/{BUCKET}={b}" for b in bs]) for c, bs in by_commit.items()]
        return functools.reduce(DataFrame.unionByName, parts)

    # ------------------------------------------------------------- writing
    def _bucket_of(self, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(n)).cast("int")

    def _touched(self, keys: DataFrame, m: dict) -> list[str]:
        """At most as many rows as there are buckets."""
        return [str(r[0]) for r in keys.select(self._bucket_of(m["n_buckets"])).distinct().collect()]

    def upsert(self, changes: DataFrame, order_col: str | None = None) -> dict[str, int]:
        """Insert or replace rows by key.  Returns the new version and how many
        rows were inserted, replaced and are stored now.

        The changes are computed once, into the shared folder, whatever they
        cost; raises ``ConcurrentWrite`` if another writer came first."""
        m = self.manifest()
        if not m["version"]:
            self.manifests.check_free()
        staged = shared_table(changes, "chunk-changes")
        if order_col:
            staged = shared_table(latest_wins(staged, [self.key], [F.col(order_col).desc()]), "chunk-changes")
        bad = staged.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 OR `{self.key}` IS NULL").first()
        if bad is not None:
            raise ValueError(f"null {self.key}" if bad[0] is None else f"several changes to {self.key} {bad[0]!r}: name the column that orders them")
        touched = self._touched(staged, m)
        if not touched and m["schema"] is not None:
            return self._result(m, {})
        columns = self._schema(m).fields if m["schema"] else []
        fields = columns + [f for f in staged.schema.fields if f.name not in {c.name for c in columns}]
        for f in staged.schema.fields:
            was = next((c for c in columns if c.name == f.name), f)
            if was.dataType != f.dataType:
                raise TypeError(f"{f.name} is {was.dataType.simpleString()} in the store and {f.dataType.simpleString()} in the changes")

        def row(df: DataFrame, alias: str) -> DataFrame:
            values = [(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]
            return df.select(F.col(self.key).alias("_k"), F.struct(*values).alias(alias))

        pairs = row(staged, "_new")
        if m["schema"] is not None:
            pairs = pairs.join(row(self._rows(m, touched).drop(BUCKET), "_old"), "_k", "full")
        else:
            pairs = pairs.withColumn("_old", F.lit(None).cast(pairs.schema["_new"].dataType))
        merged = pairs.select(
            F.coalesce("_new", "_old").alias("_row"),
            F.when(F.col("_new").isNull(), KEPT).when(F.col("_old").isNull(), INSERTED).otherwise(REPLACED).alias(STATE)).select("_row.*", STATE)
        return self._replace(m, merged, touched, StructType(fields))

    def delete(self, ids: DataFrame, columns: tuple[str, ...] = ("chunk_id",)) -> dict[str, int]:
        """Remove the rows of which one of ``columns`` is listed in the first
        column of ``ids``.  If that is the key, only its buckets are searched;
        only buckets that lose a row are rewritten."""
        m = self.manifest()
        if m["schema"] is None:
            return self._result(m, {})
        wanted = shared_table(ids.select(F.col(ids.columns[0]).alias("_id")).where("_id IS NOT NULL").distinct(), "chunk-ids")
        by_key = tuple(columns) == (self.key,)
        searched = self._touched(wanted.select(F.col("_id").alias(self.key)), m) if by_key else list(m["buckets"])
        rows = self._rows(m, searched)
        # a row without the id gets one of its own, so that such rows are spread
        lost = [rows.join(wanted, F.col(f"`{c}`") == F.col("_id"), "left_semi").select(BUCKET) for c in columns]
        touched = [str(r[0]) for r in functools.reduce(DataFrame.unionByName, lost).distinct().collect()]
        if not touched:
            return self._result(m, {})
        kept = self._rows(m, touched).drop(BUCKET)
        for c in columns:
            own = F.coalesce(F.col(f"`{c}`").cast("string"), F.concat(F.lit("\u0000"), F.col(f"`{self.key}`").cast("string")))
            kept = kept.join(wanted, own == F.col("_id").cast("string"), "left_anti")
        return self._replace(m, kept.withColumn(STATE, F.lit(KEPT)), touched, self._schema(m))

    def clear(self) -> dict[str, int]:
        """A version without rows; the earlier ones stay until ``vacuum``."""
        m = self.manifest()
        if m["schema"] is None or not m["buckets"]:
            return self._result(m, {})
        after = m | {"buckets": {}}
        after["version"] = self.manifests.commit(m["version"], after)
        return self._result(after, {}, removed=self._total(m))

    def rebucket(self, buckets: int) -> dict[str, int]:
        """The same rows in another number of buckets."""
        m = self.manifest()
        rows = self.read().withColumn(STATE, F.lit(KEPT))
        return self._replace(m | {"n_buckets": buckets, "buckets": {}}, rows, [], self._schema(m), before=self._total(m))

    def _replace(self, m: dict, rows: DataFrame, touched: list[str], schema: StructType, before: int | None = None) -> dict[str, int]:
        """Write ``rows`` as the new content of the buckets ``touched``, commit,
        and count from the column of states that was written."""
        commit = self.manifests.new_folder()
        folder = self.manifests.folder(commit)
        rows.withColumn(BUCKET, self._bucket_of(m["n_buckets"])).hint("rebalance", BUCKET) \
            .write.option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(folder)
        counted = self.spark.read.schema(f"{STATE} int, {BUCKET} int").parquet(folder).groupBy(BUCKET, STATE).count().collect()
        sizes, states = {}, {}
        for bucket, state, n in counted:  # three rows per bucket at most
            sizes[str(bucket)] = sizes.get(str(bucket), 0) + n
            states[state] = states.get(state, 0) + n
        kept = {b: x for b, x in m["buckets"].items() if b not in touched}
        after = m | {"schema": json.loads(schema.json()), "buckets": kept | {b: {"commit": commit, "rows": n} for b, n in sizes.items()}}
        after["version"] = self.manifests.commit(m["version"], after)
        before = self._total(m) if before is None else before
        return self._result(after, states, removed=before + states.get(INSERTED, 0) - self._total(after))

    @staticmethod
    def _total(m: dict) -> int:
        return sum(b["rows"] for b in m["buckets"].values())

    def _result(self, m: dict, states: dict, removed: int = 0) -> dict[str, int]:
        return {"version": m["version"], "inserted": states.get(INSERTED, 0), "replaced": states.get(REPLACED, 0),
                "removed": removed, "stored": self._total(m)}

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drop all but the last ``keep`` versions and the files that only they
        had; returns the folders deleted."""
        versions = self.manifests.versions()[-keep:]
        used = {b["commit"] for v in versions for b in self.manifests.load(v)["buckets"].values()}
        return self.manifests.vacuum(used, keep)
