"""Run-ledger roll-ups: batch statistics, error digests, retry and outage
accounting, failure streaks and progress estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ingest_batch_stats(df: DataFrame, batch_col: str = "batch_day", outcome: str = "outcome") -> DataFrame:
    """Per batch: outcome counters, and sums of chunks (successful rows only),
    attachments and attachment chunks.  Outcomes are 'successful', 'skipped'
    and 'failed' with or without a reason; others count as processed."""
    o = F.coalesce(F.col(outcome), F.lit(""))

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return df.groupBy(batch_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(o != "skipped").cast("long").alias("processed"),
        F.count_if(o == "successful").cast("long").alias("successful"),
        F.count_if(o.startswith("failed")).cast("long").alias("failed"),
        F.count_if(o == "skipped").cast("long").alias("skipped"),
        total(F.when(o == "successful", F.col("chunks"))).alias("chunks"),
        total("attachments").alias("attachments"), total("attachment_chunks").alias("attachment_chunks"))


def error_digest(errors: DataFrame, group_col: str, order_col: str, msg_col: str, keep: int = 10) -> DataFrame:
    """Per group: failed count and the first ``keep`` messages in order.

    The per-group cut happens before collecting (WindowGroupLimit), so a
    group never gathers more than ``keep`` messages."""
    w = Window.partitionBy(group_col).orderBy(order_col)
    r = errors.withColumn("_rn", F.row_number().over(w))
    firsts = r.where(F.col("_rn") <= keep).groupBy(group_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(msg_col).alias("m")))),
                    lambda s: s["m"]).alias("first_errors"))
    counts = errors.groupBy(group_col).agg(F.count(F.lit(1)).alias("failed"))
    return counts.join(firsts, group_col)


def _first_good(attempts: DataFrame, key: str, order_cols: list[str], good: Column) -> DataFrame:
    """Per key: attempts, how many were not good, and the place of the first
    good one (null if none).  Two partial aggregations: the first good position
    per key, then counts up to it; no group is sorted in one task."""
    at = F.struct(*order_cols)
    first = attempts.groupBy(F.col(key).alias("_key")).agg(F.min(F.when(good, at)).alias("_first"))
    joined = attempts.join(first, attempts[key].eqNullSafe(first["_key"]))
    place = F.count_if(at <= F.col("_first"))
    return joined.groupBy(key).agg(
        F.count(F.lit(1)).cast("long").alias("attempts"), F.count_if(~good).cast("long").alias("not_good"),
        F.when(place > 0, place).cast("long").alias("first_good"))


def _status(first_good: str) -> Column:
    return F.when(F.col(first_good).isNull(), "failed").when(F.col(first_good) == 1, "ok").otherwise("recovered")


def retry_rollup(attempts: DataFrame, key: str, order_cols: list[str], ok_col: str = "ok") -> DataFrame:
    """Per key: attempt of first success, attempts made, status, attempts used
    (an id leaves later rounds once it succeeded)."""
    g = _first_good(attempts, key, order_cols, F.col(ok_col))
    return g.select(key, F.col("first_good").alias("recovered_at"), "attempts", _status("first_good").alias("status"),
                    F.coalesce("first_good", "attempts").alias("attempts_used"))


def _rate(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, F.nullif(whole, F.lit(0))), F.lit(0.0)), 6)


def fetch_summary(per_id: DataFrame, attempts: DataFrame, skipped: DataFrame, outages: DataFrame) -> DataFrame:
    """Totals of a fetch: ids (see ``retry_rollup``), skipped ids, attempts,
    batches with outages (see ``outage_rollup``), and the rates recovered /
    retries and recovered batches / batches with outages (percent, 0 if none)."""
    recovered = F.col("recovered_at") > 1
    hit = F.col("outages") > 0
    totals = [
        per_id.agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("recovered_at") == 1).alias("first_try"),
                   F.coalesce(F.sum(F.when(recovered, F.col("recovered_at") - 1)), F.lit(0)).cast("long").alias("retries"),
                   F.count_if(recovered).alias("recovered"), F.count_if(F.col("recovered_at").isNull()).alias("failed")),
        attempts.agg(F.count(F.lit(1)).alias("attempts")),
        skipped.agg(F.count(F.lit(1)).alias("skipped")),
        outages.agg(F.count_if(hit).alias("outage_batches"), F.count_if(hit & (F.col("status") == "recovered")).alias("_back"))]
    s = totals[0]
    for one_row in totals[1:]:
        s = s.join(F.broadcast(one_row))
    return s.withColumn("recovery_rate", _rate(F.col("recovered"), F.col("retries"))) \
        .withColumn("outage_recovery_rate", _rate(F.col("_back"), F.col("outage_batches"))).drop("_back")


def outage_rollup(attempts: DataFrame, batch: str, order_cols: list[str], outage_col: str = "outage") -> DataFrame:
    """Per batch window: attempts, outages, first good attempt, status, retries used."""
    g = _first_good(attempts, batch, order_cols, ~F.col(outage_col))
    return g.select(batch, "attempts", F.col("not_good").alias("outages"), F.col("first_good").alias("first_ok_attempt"),
                    _status("first_good").alias("status"), (F.coalesce("first_good", "attempts") - 1).alias("retries_used"))


def failure_streak(runs: DataFrame, key: str, ts: str, ok_col: str = "ok") -> DataFrame:
    """Failures after the last success, per key (two partial aggregations)."""
    last = runs.groupBy(F.col(key).alias("_key")).agg(F.max(F.when(F.col(ok_col), F.col(ts))).alias("_last_ok"))
    r = runs.join(last, runs[key].eqNullSafe(last["_key"]))
    return r.groupBy(key).agg(F.count_if(~F.col(ok_col) & (F.col("_last_ok").isNull() | (F.col(ts) > F.col("_last_ok"))))
                              .cast("long").alias("streak"))


def batch_progress(ledger: DataFrame, order_col: str, seconds_col: str) -> DataFrame:
    """Percent done, running mean seconds per batch and the estimated rest.

    The ledger has one row per batch (already aggregated), so ordering it in
    one partition is bounded by the number of batches."""
    w = Window.orderBy(order_col)
    r = ledger.withColumn("_n", F.row_number().over(w)) \
        .withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy())) \
        .withColumn("_mean", F.avg(seconds_col).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.select(order_col, F.col("_n").cast("long").alias("batch_no"),
                    F.round(F.col("_n") * 100.0 / F.col("_total"), 6).alias("percent_done"),
                    F.round("_mean", 6).alias("mean_seconds"),
                    F.round(F.col("_mean") * (F.col("_total") - F.col("_n")), 6).alias("eta_seconds"))
