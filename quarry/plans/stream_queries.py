"""Registered streaming queries (rows 96-100 of the inventory): each runs a
Structured Streaming job to completion over the landed table and returns the
sink's rows for checking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.registry import register
from quarry.plans.text_queries import _redact_sql
from quarry.sources import io
from quarry.sources.tables import table
from quarry.streaming import jobs


def _landing(spark, sf, name, base):
    """The table as landed files (the stream source is a landing folder)."""
    path = base + "/landing"
    table(spark, sf, name).write.mode("overwrite").parquet(path)
    return path


@register("stream_redact", sql=f"""
SELECT conv_id, turn, role,
  CASE WHEN role = 'user' THEN {_redact_sql('text', T.HETU_PATTERNS, T.HETU_TOKEN)} ELSE text END AS text_redacted
FROM conversations
""")
def q_stream_redact(spark, sf):
    schema = table(spark, sf, "conversations").schema
    base = io.new_scratch(spark, "stream-redact")
    out = jobs.stream_redact(spark, _landing(spark, sf, "conversations", base), schema, base + "/out", base + "/ckpt")
    return out.select("conv_id", "turn", "role", F.col("text").alias("text_redacted"))


EMBARGO_CUTOFF = "2024-01-20 00:00:00"


@register("stream_embargo", sql=f"""
SELECT event_id, ts FROM events WHERE ts <= TIMESTAMP '{EMBARGO_CUTOFF}'
""")
def q_stream_embargo(spark, sf):
    schema = table(spark, sf, "events").schema
    base = io.new_scratch(spark, "stream-embargo")
    out = jobs.stream_embargo(spark, _landing(spark, sf, "events", base), schema, base + "/out", base + "/ckpt", EMBARGO_CUTOFF)
    return out.select("event_id", "ts")


@register("stream_daily_counts", sql="""
SELECT date_trunc('day', ts) AS window_start, CAST(count(*) AS BIGINT) AS events, round(sum(value), 6) AS value_sum
FROM events GROUP BY 1
""")
def q_stream_daily_counts(spark, sf):
    schema = table(spark, sf, "events").schema
    base = io.new_scratch(spark, "stream-daily")
    out = jobs.stream_daily_counts(spark, _landing(spark, sf, "events", base), schema, base + "/out", base + "/ckpt")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "events",
                      F.round("value_sum", 6).alias("value_sum"))


LATE_DELAY = "36 hours"


@register("stream_late_counts", sql=f"""
WITH drops AS (SELECT *, event_id % 3 AS drop_no FROM events),
m AS (SELECT n.drop_no, max(e.ts) - INTERVAL {LATE_DELAY} AS least FROM (SELECT DISTINCT drop_no FROM drops) n
      JOIN drops e ON e.drop_no < n.drop_no GROUP BY ALL)
SELECT date_trunc('day', ts) AS window_start, CAST(count(*) AS BIGINT) AS events,
       CAST(count(*) FILTER (WHERE ts < least) AS BIGINT) AS late_events
FROM drops LEFT JOIN m USING (drop_no) GROUP BY 1
""")
def q_stream_late_counts(spark, sf):
    """The events land in three drops, each of which spans the whole time, and
    the job runs after each: what is older than its predecessors allow is late."""
    events = table(spark, sf, "events")
    base = io.new_scratch(spark, "stream-late")
    for n in range(3):
        events.where(F.col("event_id") % 3 == n).write.parquet(f"{base}/landing/drop{n}")
        counts = jobs.stream_daily_counts(spark, base + "/landing/*", events.schema, base + "/out", base + "/ckpt", delay=LATE_DELAY)
    return counts.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "events", "late_events")


@register("stream_dedup", sql="""
SELECT DISTINCT user_id, event_type FROM events
""")
def q_stream_dedup(spark, sf):
    schema = table(spark, sf, "events").schema
    base = io.new_scratch(spark, "stream-dedup")
    out = jobs.stream_dedup(spark, _landing(spark, sf, "events", base), schema, base + "/out", base + "/ckpt",
                            ["user_id", "event_type"])
    return out.select("user_id", "event_type")


@register("stream_ingest", sql="""
SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS native_id, o_orderstatus AS status FROM orders
""")
def q_stream_ingest(spark, sf):
    """Raw archive lines land in two drops (the second re-sends a third of the
    ids with an older timestamp); the stream upserts latest-wins by id."""
    o = table(spark, sf, "orders")
    rows = o.select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("native_id"),
                    F.col("o_orderdate").cast("timestamp").alias("fetched_at"),
                    F.col("o_orderstatus").alias("status"))
    base = io.new_scratch(spark, "stream-ingest")
    rows.write.mode("overwrite").json(base + "/landing/drop1")
    rows.where(F.col("native_id").endswith("3")).withColumn("status", F.lit("stale")) \
        .withColumn("fetched_at", F.col("fetched_at") - F.expr("INTERVAL 1 DAY")) \
        .write.mode("overwrite").json(base + "/landing/drop2")
    t = jobs.stream_ingest(spark, base + "/landing/*", "native_id string, fetched_at timestamp, status string",
                           base + "/table", base + "/ckpt", "native_id", "fetched_at")
    return t.select("native_id", "status")
