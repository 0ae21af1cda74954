"""Threshold join: equal to all scores by hand, bounds that save scores, cells that are not read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import threshold
from quarry.operators.retrieval import CellIndex

ROWS, QUERIES, DIMS = 900, 60, 16
SCHEMA = "chunk_id long, embedding array<double>, note string"


def _vectors(kind):
    rng = np.random.default_rng(5)
    if kind == "clustered":
        centres = rng.normal(size=(6, DIMS))
        rows = centres[rng.integers(0, 6, ROWS)] + 0.15 * rng.normal(size=(ROWS, DIMS))
        return rows, centres[rng.integers(0, 2, QUERIES)] + 0.1 * rng.normal(size=(QUERIES, DIMS))
    rows = rng.normal(size=(ROWS, DIMS))
    rows[500:800] = rows[7]  # a third of all rows are one vector
    return rows, rng.normal(size=(QUERIES, DIMS))


def _frames(spark, rows, queries):
    corpus = [(i, v.tolist(), f"n{i}") for i, v in enumerate(rows)] + [(10_000, None, None), (10_001, [0.0] * DIMS, "z"), (10_002, [1.0], "s")]
    asked = [(i, v.tolist()) for i, v in enumerate(queries)] + [(900, None), (901, [0.0] * DIMS)]
    return (spark.createDataFrame(corpus, SCHEMA).repartition(5), spark.createDataFrame(asked, "qid long, embedding array<double>"))


def _all(rows, queries, least):
    u = rows / np.linalg.norm(rows, axis=1)[:, None]
    s = np.round(queries / np.linalg.norm(queries, axis=1)[:, None] @ u.T, 6)
    return {(q, r): s[q, r] for q, r in zip(*np.nonzero(s >= least))}


@pytest.mark.parametrize("kind", ["clustered", "spread"])
@pytest.mark.parametrize("least", [-1.0, 0.3, 0.9, 1.5])
def test_pairs_and_counts_equal_brute_force(spark, kind, least):
    rows, queries = _vectors(kind)
    corpus, asked = _frames(spark, rows, queries)
    want = _all(rows, queries, least)
    got = threshold.score_pairs(corpus, asked, least, carry=["note"]).collect()
    assert {(r["qid"], r["chunk_id"]) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r["score"] - want[r["qid"], r["chunk_id"]]) <= 1e-6 and r["note"] == f"n{r['chunk_id']}" for r in got)
    counts = {r["qid"]: r for r in threshold.pair_counts(corpus, asked, least, 4, max_block_bytes=(DIMS * 8 + 64) * 25).collect()}
    assert set(counts) == {*range(QUERIES), 900, 901}
    for q, r in counts.items():
        mine = sorted((-s, c) for (a, c), s in want.items() if a == q)
        assert r["pairs"] == len(mine) <= r["scored"] <= ROWS
        assert [b["chunk_id"] for b in r["best"]] == [c for _, c in mine[:4]]


def test_bounds_save_scores(spark):
    corpus, asked = _frames(spark, *_vectors("clustered"))
    scored = threshold.pair_counts(corpus, asked, 0.9, 1).agg(F.sum("scored")).first()[0]
    assert scored < 0.5 * ROWS * QUERIES


def test_stored_cells_give_the_same_and_skip(spark, tmp_path):
    rows, queries = _vectors("clustered")
    corpus, asked = _frames(spark, rows, queries)
    CellIndex.build(corpus.where("size(embedding) > 1"), str(tmp_path / "i"), n_cells=6)
    index = CellIndex(spark, str(tmp_path / "i"))
    want = _all(rows, queries, 0.9)
    got = threshold.score_pairs(index, asked, 0.9).collect()
    assert sorted((r["qid"], r["chunk_id"]) for r in got) == sorted(want)
    counted = threshold.pair_counts(index, asked, 0.9, 2).agg(F.sum("pairs"), F.sum("scored")).first()
    assert counted[0] == len(want) and counted[1] < 0.5 * ROWS * QUERIES


def test_empty_sides(spark):
    corpus, asked = _frames(spark, *_vectors("spread"))
    assert threshold.score_pairs(corpus.limit(0), asked, 0.1).count() == 0
    assert threshold.score_pairs(corpus, asked.limit(0), 0.1).count() == 0
    assert threshold.pair_counts(corpus, asked.limit(0), 0.1, 3).count() == 0
    assert {(r["pairs"], r["scored"], len(r["best"])) for r in threshold.pair_counts(corpus.limit(0), asked, 0.1, 3).collect()} == {(0, 0, 0)}
