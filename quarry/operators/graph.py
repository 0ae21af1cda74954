"""Breadth-first frontier over an edge table (crawl reachability)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch_path


def crawl_frontier(edges: DataFrame, start: DataFrame, src: str = "src", dst: str = "dst", buckets: int | None = None) -> DataFrame:
    """Nodes reachable from ``start`` (column ``node``) with their BFS depth.

    Edges are written once in buckets of their source and the visited set in
    buckets of its nodes, which grows by a file per bucket and round.  So a
    round moves the frontier and what it finds, but neither the edges nor what
    was visited before.  The search ends when a round finds nothing new,
    whatever its depth.  Null nodes are no nodes; an empty start reaches none.
    """
    spark = start.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"quarry_crawl_{uuid.uuid4().hex}"

    def keep(df: DataFrame, table: str, key: str, mode: str = "error") -> DataFrame:
        path = scratch_path(spark, f"{name}_{table}")
        df.write.mode(mode).option("path", path).format("parquet").bucketBy(n, key).sortBy(key).saveAsTable(f"{name}_{table}")
        return spark.table(f"{name}_{table}")

    links = keep(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "links", "src")
    visited = keep(start.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0).cast("long")), "visited", "node")
    depth = 0
    while True:
        frontier = visited.where(F.col("depth") == depth).select("node")
        found = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        fresh = found.join(visited.select("node"), "node", "left_anti")
        depth += 1
        # a table is not read and written in one job
        new = fresh.withColumn("depth", F.lit(depth).cast("long")).checkpoint()
        if new.isEmpty():
            return visited
        visited = keep(new, "visited", "node", "append")
