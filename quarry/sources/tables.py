"""Access to the shared parquet tables (one file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read one table; column pruning and filters reach the parquet scan.

    ``spread`` is for CPU-heavy per-row work (regex, parsing): a scan with
    fewer partitions than cores is spread out first (no-op on big tables)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread:
        from quarry.operators.partitioning import fan_out
        df = fan_out(df, df.columns[0])
    return df
