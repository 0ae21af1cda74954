"""Knowledge publishing: full refresh of a named collection, and the
config-driven import that picks a source by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.io import partition_folder


def full_refresh_publish(entries: DataFrame, path: str, collection: str, prefix: str = "") -> DataFrame:
    """Replace collection ``collection`` by all entries: duplicate contents
    are skipped (first id wins), optional name prefix, written as the
    partition collection=<name> (other collections untouched); without entries
    the collection is left empty.  Returns the publish summary, one row:
    entries written and their mean token count."""
    keyed = entries.withColumn("_h", F.sha2("content", 256))
    dedup = keyed.groupBy("_h").agg(F.min("doc_id").alias("doc_id"),
                                    F.min_by("content", F.col("doc_id")).alias("content"))
    out = dedup.select(F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("name"), "content",
                       T.token_count("content").alias("tokens"))
    folder = partition_folder(entries.sparkSession, path, collection=collection)
    out.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
    back = entries.sparkSession.read.schema(out.schema).parquet(folder)
    return back.agg(F.count(F.lit(1)).alias("entries"),
                    F.round(F.coalesce(F.avg("tokens"), F.lit(0.0)), 6).alias("mean_tokens")) \
        .select(F.lit(collection).alias("collection"), "entries", "mean_tokens")


def import_from_config(spark: SparkSession, config: dict, sources: dict) -> DataFrame:
    """Dispatch on ``config['type']`` in {csv_excel, web, events_api};
    ``sources`` maps the type to a DataFrame-producing callable.  Unknown
    types raise, as the importer does."""
    kind = config.get("type")
    if kind not in ("csv_excel", "web", "events_api"):
        raise ValueError(f"Unsupported data type: {kind}")
    entries = sources[kind](spark, config)
    prefix = config.get("data", {}).get("prefix", "")
    return entries.withColumn("file_name", F.concat(F.lit(prefix), F.col("file_name")))


def publish_all(spark: SparkSession, configs: list[dict], sources: dict, path: str, verify_only: bool = False) -> DataFrame:
    """Import and publish each config's entries as its ``collection`` below
    ``path``; one row per config: type, collection, entries, error.  A config
    that fails leaves the others alone.  ``verify_only`` publishes nothing and
    fails configs whose source yields no entry."""
    done = []
    for cfg in configs:
        row = [str(cfg.get("type")), cfg.get("collection", ""), 0, None]
        try:
            entries = import_from_config(spark, cfg, sources).select(F.col("file_name").alias("doc_id"), "content")
            if verify_only:
                if entries.isEmpty():
                    raise ValueError("the source yields no entry")
            else:
                row[2] = full_refresh_publish(entries, path, row[1]).first()["entries"]
        except Exception as e:  # noqa: BLE001 -- reported in the config's row
            row[3] = f"{type(e).__name__}: {e}"
        done.append(tuple(row))
    return spark.createDataFrame(done, "type string, collection string, entries long, error string")
