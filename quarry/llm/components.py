"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """(node, label): ``label`` is the smallest node reachable through
    ``edges`` (src, dst; either direction).  Each round takes the smallest
    label among neighbours and then the label's own label, so paths halve;
    every round is written to the shared folder.  Ends when no label changes."""
    both = store(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
                 .where("src <> dst").distinct(), "edges")
    labels = store(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m"))
                   .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.withColumnsRenamed({"node": "dst"}), "dst")
                .groupBy("src").agg(F.min("label").alias("m")))
        step = labels.join(near, F.col("node") == F.col("src")).select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = store(step.join(jump, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        if not after.where("old <> label").limit(1).count():
            return after.select("node", "label")
        labels = after.select("node", "label")
