"""The chunk store: two calls on one path keep both, untouched files stay as
they are, counts, versions, concurrent writers."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.sources.chunk_store import ChunkStore
from quarry.sources.manifest import ConcurrentWrite, Manifests

SCHEMA = "chunk_id string, native_id string, n long"


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(os.path.join(path, "data")) for f in fs if f.endswith(".parquet")}


def _rows(store, version=None):
    return sorted(map(tuple, store.read(version).collect()), key=repr)


def test_upserts_on_one_path_add_up(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=8)
    assert not store.exists()
    first = [(f"c{k}", "a", k) for k in range(100)]
    assert store.upsert(spark.createDataFrame(first, SCHEMA)) == {"version": 1, "inserted": 100, "replaced": 0, "removed": 0, "stored": 100}
    before = _files(store.path)
    second = [("c3", "b", 1000), ("new", "b", 1)]
    again = ChunkStore(spark, store.path)  # found again by its path, with its number of buckets
    assert again.upsert(spark.createDataFrame(second, SCHEMA)) == {"version": 2, "inserted": 1, "replaced": 1, "removed": 0, "stored": 101}
    expected = sorted([r for r in first if r[0] != "c3"] + second, key=repr)
    assert _rows(store) == expected and _rows(store, 1) == sorted(first, key=repr) and store.count() == 101
    after = _files(store.path)
    assert all(after[f] == t for f, t in before.items())
    buckets = [store.manifest(v)["buckets"] for v in (1, 2)]
    changed = [b for b in buckets[1] if buckets[0].get(b) != buckets[1][b]]
    assert 1 <= len(changed) <= 2
    assert sorted(r["n"] for r in store.lookup(spark.createDataFrame([("c3",), ("new",), ("none",), (None,)], "id string")).collect()) == [1, 1000]
    assert store.upsert(spark.createDataFrame([], SCHEMA))["version"] == 2


def test_deletes_clear_and_vacuum(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    rows = [("a_0", "a", None), ("a_1", "a", None), ("a_att", "a1", "a"), ("b_0", "b", None), ("n", None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, native_id string, decision_native_id string")
    store.upsert(df)
    ids = spark.createDataFrame([("a",), ("missing",), (None,)], "id string")
    gone = store.delete(ids, ("native_id", "decision_native_id"))
    assert (gone["removed"], gone["stored"], gone["version"]) == (3, 2, 2)
    assert [r[0] for r in _rows(store)] == ["b_0", "n"]
    assert store.delete(ids, ("native_id", "decision_native_id"))["version"] == 2
    assert store.delete(spark.createDataFrame([("n",)], "id string"))["removed"] == 1
    store.rebucket(7)
    assert [r[0] for r in _rows(store)] == ["b_0"] and store.manifest()["n_buckets"] == 7
    assert store.clear()["removed"] == 1 and _rows(store) == [] and store.read().columns == df.columns
    assert len(_rows(store, 1)) == 5
    store.vacuum()
    assert _files(store.path) == {} and store.manifests.versions() == [5] and _rows(store) == []


def test_order_column_nulls_and_new_columns(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    twice = spark.createDataFrame([("x", "old", 1), ("x", "new", 2), ("y", "only", 0)], SCHEMA)
    with pytest.raises(ValueError, match="several changes"):
        store.upsert(twice)
    with pytest.raises(ValueError, match="null"):
        store.upsert(spark.createDataFrame([(None, "a", 1)], SCHEMA))
    assert not store.exists()
    assert store.upsert(twice, order_col="n")["inserted"] == 2
    wider = spark.createDataFrame([("y", 1.5)], "chunk_id string, score double")
    assert store.upsert(wider)["replaced"] == 1
    assert _rows(store) == [("x", "new", 2, None), ("y", None, None, 1.5)]
    with pytest.raises(TypeError, match="score"):
        store.upsert(spark.createDataFrame([("y", "z")], "chunk_id string, score string"))


def test_the_loser_of_two_writers_fails(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.upsert(spark.createDataFrame([("a", "1", 1)], SCHEMA))
    base = store.manifest()
    store.upsert(spark.createDataFrame([("b", "1", 1)], SCHEMA))
    late = ChunkStore(spark, store.path)
    monkeypatch.setattr(late, "manifest", lambda version=None: base)  # it had read the store before
    with pytest.raises(ConcurrentWrite):
        late.upsert(spark.createDataFrame([("a", "lost", 9), ("c", "lost", 9)], SCHEMA))
    assert [r[0] for r in _rows(store)] == ["a", "b"] and store.manifest()["version"] == 2
    store.vacuum(keep=2)
    assert len(_rows(store)) == 2 and len(_rows(store, 1)) == 1


def test_a_store_without_versions_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ChunkStore(spark, str(tmp_path / "none")).read()
    assert Manifests(spark, str(tmp_path / "none")).load() is None


def test_many_rows_of_one_document(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=4)
    rows = spark.range(3000).select(F.concat(F.lit("d_"), F.col("id").cast("string")).alias("chunk_id"), F.lit("d").alias("native_id"), F.col("id").alias("n"))
    assert store.upsert(rows)["inserted"] == 3000
    assert store.delete(spark.createDataFrame([("d",)], "id string"), ("native_id",)) == {
        "version": 2, "inserted": 0, "replaced": 0, "removed": 3000, "stored": 0}
