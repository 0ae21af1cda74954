"""Date helpers: lenient parsing, ISO text, date windows, embargo bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Declared formats tried in order by ``parse_lenient``.
DEFAULT_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy/MM/dd",
                   "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy")
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_lenient(c, formats=DEFAULT_FORMATS) -> Column:
    """First format that parses wins; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(_c(c), F.lit(f)) for f in formats])


def iso_text(ts) -> Column:
    """Timestamp -> 'YYYY-MM-DDTHH:MM:SS'."""
    return F.date_format(_c(ts), ISO_FORMAT)


def date_batches(df: DataFrame, start: str, end: str, step_days: int = 7, backwards: bool = False,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Half-open windows of ``step_days`` between two timestamps, last one cut.

    Forward: [s, s+step), ... up to ``end``.  Backwards: ``start`` is the later
    bound and windows walk down to ``end``.  Adds ``weeks`` = ceil(days/7).
    """
    step = F.expr(f"INTERVAL {int(step_days)} DAYS")
    s, e = F.col(start), F.col(end)
    if not backwards:
        seq = F.when(s < e, F.sequence(s, e, step))
        out = df.select(*keep, s.alias("_s"), e.alias("_e"), F.posexplode(seq).alias("batch_index", "batch_start"))
        out = out.where(F.col("batch_start") < F.col("_e")).select(
            *keep, F.col("batch_index").cast("long").alias("batch_index"), "batch_start",
            F.least(F.col("batch_start") + step, F.col("_e")).alias("batch_end"), "_s", "_e")
        days = F.floor((F.unix_micros(F.col("_e").cast("timestamp")) - F.unix_micros(F.col("_s").cast("timestamp"))) / F.lit(86_400_000_000))
    else:
        seq = F.when(s > e, F.sequence(s, e, -step))
        out = df.select(*keep, s.alias("_s"), e.alias("_e"), F.posexplode(seq).alias("batch_index", "batch_end"))
        out = out.where(F.col("batch_end") > F.col("_e")).select(
            *keep, F.col("batch_index").cast("long").alias("batch_index"),
            F.greatest(F.col("batch_end") - step, F.col("_e")).alias("batch_start"), "batch_end", "_s", "_e")
        days = F.floor((F.unix_micros(F.col("_s").cast("timestamp")) - F.unix_micros(F.col("_e").cast("timestamp"))) / F.lit(86_400_000_000))
    return out.withColumn("weeks", F.floor((days + 6) / 7).cast("long")).drop("_s", "_e")


def embargo_bounds(now) -> tuple[Column, Column]:
    """[now-39 d at 00:00:00, now-38 d at 23:59:59]."""
    n = _c(now)
    lo = F.date_trunc("day", n - F.expr("INTERVAL 39 DAYS"))
    hi = F.date_trunc("day", n - F.expr("INTERVAL 38 DAYS")) + F.expr("INTERVAL 23 HOURS 59 MINUTES 59 SECONDS")
    return lo, hi
