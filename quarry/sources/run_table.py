"""Keyed table that grows by runs, with levelled compaction.

Every batch adds one run: its newest row of each key, in files of ascending key
ranges.  When ``fanout`` runs are on a level they are merged into one run of the
next, so a row is rewritten once a level, and a table of n batches has at most
(fanout - 1) runs on each of log n levels, whatever n is.  A reader takes the
newest row of each key over these runs, and one run alone is read as it is.

The manifest (see ``manifest``) lists the runs and the last batch of each
writer, so a batch that comes again adds nothing.  Merging and adding may go on
side by side: each commits on top of the other.

Defined results: the newest row is the one with the greatest order column, ties
go to the later batch; a null order value is older than any; a null key is a key
like others; an empty batch is remembered and adds no run; columns are those of
the first batch.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from quarry.operators.relational import latest_wins
from quarry.sources.manifest import ConcurrentWrite, Manifests

SEQUENCE = "_sequence"


class RunTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], order_col: str, fanout: int = 4):
        self.spark, self.path, self.key, self.order_col, self.fanout = spark, path, key, order_col, fanout
        self.manifests = Manifests(spark, path)

    def manifest(self) -> dict:
        return self.manifests.load() or {"version": 0, "schema": None, "runs": [], "writers": {}, "sequence": 0}

    # ------------------------------------------------------------- writing
    def add(self, batch: DataFrame, batch_id: int, writer: str = "") -> bool:
        """Add a batch unless this writer has added it before; whether it did."""
        m = self.manifest()
        if batch_id <= m["writers"].get(writer, -1):
            return False
        if not m["version"]:
            self.manifests.check_free()
        sequence = m["sequence"] + 1
        run = self._write(batch.withColumn(SEQUENCE, F.lit(sequence).cast("long")), level=0)
        schema = json.loads(batch.schema.json())

        def change(now: dict) -> dict:
            return now | {"schema": now["schema"] or schema, "runs": now["runs"] + ([run] if run["rows"] else []),
                          "writers": now["writers"] | {writer: batch_id}, "sequence": max(now["sequence"], sequence)}

        self._commit(change)
        return True

    def compact(self) -> int:
        """Merge every level that is full; returns how many merges were done."""
        done = 0
        while (full := self._full()) is not None:
            self._merge(full, level=full[0]["level"] + 1)
            done += 1
        return done

    def optimize(self) -> None:
        """One run, which readers take without comparing rows."""
        runs = self.manifest()["runs"]
        if len(runs) > 1:
            self._merge(runs, level=max(r["level"] for r in runs))

    def _full(self) -> list[dict] | None:
        levels: dict[int, list[dict]] = {}
        for run in self.manifest()["runs"]:
            levels.setdefault(run["level"], []).append(run)
        return next((runs for _, runs in sorted(levels.items()) if len(runs) >= self.fanout), None)

    def _merge(self, runs: list[dict], level: int) -> None:
        merged = self._write(self._rows(self.manifest(), runs), level)
        old = {r["commit"] for r in runs}

        def change(now: dict) -> dict | None:
            if not old <= {r["commit"] for r in now["runs"]}:
                return None  # another job has merged one of them
            return now | {"runs": [r for r in now["runs"] if r["commit"] not in old] + [merged]}

        self._commit(change)

    def _write(self, rows: DataFrame, level: int) -> dict:
        """A run: the newest row of each key, files of ascending key ranges."""
        commit = self.manifests.new_folder()
        folder = self.manifests.folder(commit)
        newest = latest_wins(rows, self.key, [F.col(self.order_col).desc(), F.col(SEQUENCE).desc()])
        newest.repartitionByRange(*self.key).sortWithinPartitions(*self.key).write.parquet(folder)
        return {"commit": commit, "level": level, "rows": self.spark.read.schema(newest.schema).parquet(folder).count()}

    def _commit(self, change: Callable[[dict], dict | None]) -> None:
        while True:
            now = self.manifest()
            after = change(now)
            if after is None:
                return
            try:
                self.manifests.commit(now["version"], after)
                return
            except ConcurrentWrite:
                continue  # on top of what the other job wrote

    # ------------------------------------------------------------- reading
    def _rows(self, m: dict, runs: list[dict]) -> DataFrame:
        schema = StructType.fromJson(m["schema"]).add(SEQUENCE, LongType())
        return functools.reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(self.manifests.folder(r["commit"])) for r in runs])

    def read(self) -> DataFrame:
        """The newest row of each key."""
        m = self.manifest()
        if m["schema"] is None:
            raise FileNotFoundError(f"no table at {self.path}")
        if not m["runs"]:
            return self.spark.createDataFrame([], StructType.fromJson(m["schema"]))
        rows = self._rows(m, m["runs"])
        if len(m["runs"]) > 1:
            rows = latest_wins(rows, self.key, [F.col(self.order_col).desc(), F.col(SEQUENCE).desc()])
        return rows.drop(SEQUENCE)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drop all but the last ``keep`` versions and the runs that only they
        had.  Readers of a version that is gone fail."""
        used = {r["commit"] for v in self.manifests.versions()[-keep:] for r in self.manifests.load(v)["runs"]}
        return self.manifests.vacuum(used, keep)
