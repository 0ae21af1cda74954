"""Structured Streaming versions of the incremental jobs.

Every job reads a file source incrementally, runs with
``trigger(availableNow=True)`` (process what has landed, then stop) and keeps
its progress in a checkpoint folder, so a re-run resumes where the last one
stopped and an executor loss replays only the unfinished micro-batch.
"""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.run_table import RunTable


def _read(spark: SparkSession, source: str, schema) -> DataFrame:
    """File source over a landing folder; at most 64 new files per
    micro-batch so a large backlog is taken in bounded steps."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)


def _event_time(df: DataFrame, ts_col: str) -> DataFrame:
    """Watermarks need TIMESTAMP (session-zone) event time."""
    return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_redact(spark: SparkSession, source: str, schema, out: str, checkpoint: str,
                  profile: str = "hetu") -> DataFrame:
    """User messages redacted in flight (stateless select); file sink with
    exactly-once commit log."""
    s = _read(spark, source, schema)
    red = s.withColumn("text", F.when(F.col("role") == "user", T.redact_pii("text", profile))
                       .otherwise(F.col("text")))
    _run(red.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    return spark.read.parquet(out)


def stream_embargo(spark: SparkSession, source: str, schema, out: str, checkpoint: str, cutoff: str,
                   ts_col: str = "ts") -> DataFrame:
    """Rows at or before the run's cut-off.  Every row is taken once into the
    table at ``out``, by day; a row that is too young stays there and is
    released by the first run with a later cut-off."""
    s = _read(spark, source, schema).withColumn("_day", F.to_date(ts_col))
    _run(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .partitionBy("_day").trigger(availableNow=True).start())
    limit = F.lit(cutoff).cast("timestamp_ntz")
    return spark.read.parquet(out).where((F.col("_day") <= F.to_date(limit)) & (F.col(ts_col) <= limit)).drop("_day")


def stream_daily_counts(spark: SparkSession, source: str, schema, out: str, checkpoint: str,
                        ts_col: str = "ts", size: str = "1 day", delay: str = "0 seconds") -> DataFrame:
    """Tumbling event-time windows: window_start, events, value_sum, and how
    many of the events were late.  Each micro-batch writes its own partial
    counts under its batch id (a replay overwrites them), and a window is the
    sum of its parts.  So no state is held, no row is lost for being late, and
    neither the number nor the order of files changes events and value_sum.

    A row is late if it is older, by more than ``delay``, than the newest row
    of all earlier batches.  That mark is kept per batch beside its counts, so
    a batch reads the mark of the one before, however many there were; it comes
    from what the batch has stored, which a task that runs twice cannot change.
    Rows without a time are counted in a window that starts at null, never late.
    ``batch_report`` has the counts per batch."""
    s = _event_time(_read(spark, source, schema), ts_col)

    def sink(batch: DataFrame, batch_id: int):
        session = batch.sparkSession
        before = session.read.parquet(_mark(out, batch_id - 1)).first()["newest"] if batch_id else None
        least = F.lit(before) - F.expr(f"INTERVAL {delay}") if before is not None else F.lit(None).cast("timestamp")
        part = f"{out}/batch_id={batch_id}"
        undated = F.col(ts_col).isNull()
        batch.groupBy(F.window(F.coalesce(ts_col, F.timestamp_seconds(F.lit(0))), size).alias("w"), undated.alias("undated")) \
            .agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value_sum"),
                 F.count_if(F.coalesce(F.col(ts_col) < least, F.lit(False))).alias("late_events"), F.max(ts_col).alias("newest")) \
            .select(F.when(~F.col("undated"), F.col("w.start")).alias("window_start"), "events", "value_sum", "late_events", "newest") \
            .write.mode("overwrite").parquet(part)
        newest = session.read.parquet(part).agg(F.max("newest").alias("newest"))
        newest.select(F.greatest("newest", F.lit(before).cast("timestamp")).alias("newest")) \
            .write.mode("overwrite").parquet(_mark(out, batch_id))

    _run(s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return spark.read.parquet(out).groupBy("window_start").agg(
        F.sum("events").alias("events"), F.sum("value_sum").alias("value_sum"), F.sum("late_events").alias("late_events"))


def _mark(out: str, batch_id: int) -> str:
    """Where the newest event time up to a batch is kept (a hidden folder, no part of the counts)."""
    return f"{out}/_marks/{batch_id}"


def batch_report(spark: SparkSession, out: str) -> DataFrame:
    """Per micro-batch of ``stream_daily_counts``: batch_id, windows it touched,
    events, late_events, and its newest event time."""
    return spark.read.parquet(out).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("events").alias("events"), F.sum("late_events").alias("late_events"),
        F.max("newest").alias("newest"))


#: Texts that carry a row through a Python function without loss.
ROW_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_dedup(spark: SparkSession, source: str, schema, out: str, checkpoint: str, keys: list[str],
                 ts_col: str = "ts") -> DataFrame:
    """The first row of each key, whenever it comes again: a micro-batch adds
    the keys that no earlier batch has seen, its earliest row of each (a null
    time is the earliest, equal times go by the row's text).

    Which keys were seen is keyed state in RocksDB, dealt out by the hash of
    the key: a batch looks up its own keys and writes what changed, so its cost
    does not grow with the keys of all batches before.  A null key is a key."""
    s = _event_time(_read(spark, source, schema), ts_col)
    never = -(1 << 63)
    packed = s.select(*keys, F.coalesce(F.unix_micros(ts_col), F.lit(never)).alias("_at"),
                      F.to_json(F.struct(*[F.col(f"`{c}`") for c in s.columns]), ROW_FORMAT).alias("_row"))

    def first(_key, frames, state):
        if state.exists:
            return
        best = min((min(zip(f["_at"], f["_row"])) for f in frames), default=None)
        if best is not None:
            state.update((True,))
            yield pd.DataFrame({"_row": [best[1]]})

    fresh = packed.groupBy(*keys).applyInPandasWithState(first, "_row string", "seen boolean", "append", "NoTimeout")
    rows = fresh.select(F.from_json("_row", s.schema, ROW_FORMAT).alias("_r")).select("_r.*")
    with _settings(spark, STATE_STORE):
        _run(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    return spark.read.schema(s.schema).parquet(out)


def stream_ingest(spark: SparkSession, source: str, schema, table_path: str, checkpoint: str,
                  key: str = "native_id", order_col: str = "fetched_at", max_files: int | None = None) -> DataFrame:
    """New raw rows -> latest-wins upsert, resumable.  Each micro-batch adds a
    run to the levelled table at ``table_path`` (a replayed one adds nothing),
    and full levels are merged, so what a reader opens does not grow with the
    number of batches.  The newest row wins, in whichever batch it came."""
    reader = spark.readStream.schema(schema)
    s = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(source)
    runs = RunTable(spark, table_path, [key], order_col)

    def sink(batch: DataFrame, batch_id: int):
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")  # kept in the checkpoint
        if runs.add(batch, batch_id, query or checkpoint):
            runs.compact()

    _run(s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    return runs.read()
