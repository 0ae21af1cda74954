"""What is stored to be read in part: the cell index, page order, crawl buckets."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.operators.graph import crawl_frontier
from quarry.operators.relational import PageIndex, trim_finished_runs


def _vectors(spark, n, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).standard_normal((12, 16))
    rows = [(seed * 100_000 + k, (centres[k % 12] + spread * rng.standard_normal(16)).tolist()) for k in range(n)]
    return spark.createDataFrame(rows + [(seed * 100_000 + n, None), (seed * 100_000 + n + 1, [0.0] * 16)], "chunk_id long, embedding array<double>")


def test_cell_index_is_fitted_once(spark, tmp_path, monkeypatch):
    corpus, queries = _vectors(spark, 1500, 1), _vectors(spark, 25, 2).withColumnRenamed("chunk_id", "qid")
    path = str(tmp_path / "index")
    retrieval.CellIndex.build(corpus, path)

    def refuse(*a, **k):
        raise AssertionError("fitted again")
    monkeypatch.setattr(retrieval, "_centres", refuse)
    key = lambda df: {(r["qid"], r["chunk_id"]) for r in df.collect()}
    exact = key(retrieval.knn_search(corpus, queries, 10))
    index = retrieval.CellIndex(spark, path)
    assert key(index.search(queries, 10, recall=1)) == exact  # the bound loses nothing
    assert len(key(retrieval.approx_knn(corpus, queries, 10, path=path)) & exact) >= 0.9 * len(exact)
    unit = np.array([v for (v,) in queries.select("embedding").where("qid < 200025").collect()])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    looked = index.cells(unit, 10, 1.0)
    assert looked.sum(axis=1).max() < 0.5 * len(index.centres)  # cells of other clusters cannot hold one of the best
    more = _vectors(spark, 400, 3)
    before = set((tmp_path / "index" / "data").iterdir())
    wider = index.add(more)
    assert before < set((tmp_path / "index" / "data").iterdir()) and wider.sizes.sum() == 1900
    assert key(wider.search(queries, 10, recall=1)) == key(retrieval.knn_search(corpus.union(more), queries, 10))
    assert retrieval.CellIndex(spark, path).sizes.sum() == 1900
    with pytest.raises(FileNotFoundError):
        retrieval.CellIndex(spark, str(tmp_path / "none"))


def test_cell_index_of_nothing(spark, tmp_path):
    none = _vectors(spark, 10, 1).limit(0)
    index = retrieval.CellIndex.build(none, str(tmp_path / "i"))
    assert index.search(_vectors(spark, 3, 2).withColumnRenamed("chunk_id", "qid"), 5).count() == 0


def test_every_page_of_a_stored_order(spark):
    df = spark.range(1003).select((F.col("id") * 7919 % 1003).alias("k"), F.lit("x").alias("v"))
    index = PageIndex(df, ["k"], 6)
    assert (index.total, index.pages(50)) == (1003, 21)
    got = [[r["k"] for r in index.page(n, 50).collect()] for n in (1, 2, 9, 20, 21, 22)]
    assert got == [list(range((n - 1) * 50, min(n * 50, 1003))) for n in (1, 2, 9, 20, 21, 22)]
    last = index.page(21, 50)
    assert len([r for r in index.ranges if r[1] + r[2] > 1000]) == 1
    last.collect()
    assert re.search(r"PartitionFilters: \[[^\]]*_part#\d+ = 5\)", last._jdf.queryExecution().executedPlan().toString())  # the last range alone
    empty = PageIndex(df.limit(0), ["k"], 3)
    assert (empty.total, empty.pages(10)) == (0, 1) and empty.page(1, 10).collect() == []


def test_crawl_moves_the_frontier_only(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 3) % 50}") for i in range(50)] + [(f"n{i}", f"n{i + 1}") for i in range(49)]
                                  + [(None, "n1"), ("n1", None)], "src string, dst string")
    start = spark.createDataFrame([("n1",), (None,), ("n1",)], "node string")
    got = dict(map(tuple, crawl_frontier(edges, start, buckets=4).collect()))
    links, seen, now, depth = {}, {"n1": 0}, {"n1"}, 0
    for s, d in edges.collect():
        links.setdefault(s, set()).add(d)
    while now:
        depth += 1
        now = {d for s in now for d in links.get(s, ()) if d is not None} - set(seen)
        seen |= {d: depth for d in now}
    assert got == seen
    assert crawl_frontier(edges, start.limit(0), buckets=4).collect() == []


def test_trimming_leaves_unfinished_runs(spark):
    rows = [("a", k, "done") for k in range(5)] + [("a", 9, "running"), ("a", 0, None), ("b", 1, "done"), (None, 1, "done"), (None, 2, "done")]
    df = spark.createDataFrame(rows, "job string, at int, state string")
    got = trim_finished_runs(df, ["job"], [F.col("at").desc()], 1, F.col("state") == "done").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", 4, "done"), ("a", 9, "running"), ("a", 0, None), ("b", 1, "done"), (None, 2, "done")], key=repr)
    assert trim_finished_runs(df.limit(0), ["job"], [F.col("at").desc()], 1, F.col("state") == "done").count() == 0
