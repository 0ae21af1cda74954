"""Partition helpers used before CPU-heavy stages."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fan_out(df: DataFrame, *keys: str, min_partitions: int | None = None) -> DataFrame:
    """Spread a thin scan over the cluster before heavy per-row work.

    A scan of few large row groups yields fewer tasks than cores; then the
    rows are hash-partitioned (by ``keys`` when given, else round-robin).
    When the scan already has enough partitions -- the normal case on a big
    table -- the plan is returned unchanged and no shuffle is added.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)
