"""The levelled table and the streams on it: replays, merges, many batches;
dedup by keyed state over many files."""

import datetime as dt
import json
import random

import pytest

from quarry.sources.manifest import ConcurrentWrite
from quarry.sources.run_table import RunTable
from quarry.streaming import jobs

SCHEMA = "k string, at long, v string"


def _newest(batches):
    best = {}
    for n, rows in enumerate(batches):
        for k, at, v in rows:
            rank = (at is not None, at or 0, n)
            if k not in best or rank >= best[k][0]:
                best[k] = (rank, (k, at, v))
    return sorted((r for _, r in best.values()), key=repr)


def test_runs_stay_few_and_rows_newest(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(k, rng.choice([None, rng.randint(0, 50)]), f"{n}") for k in rng.sample([None, *"abcdefghijkl"], 5)] for n in range(14)]
    table = RunTable(spark, str(tmp_path / "t"), ["k"], "at", fanout=3)
    for n, rows in enumerate(batches):
        assert table.add(spark.createDataFrame(rows, SCHEMA), n, "w")
        table.compact()
        assert not table.add(spark.createDataFrame([("a", 10_000, "replayed")], SCHEMA), n, "w")
        levels = [r["level"] for r in table.manifest()["runs"]]
        assert all(levels.count(x) < 3 for x in levels) and len(levels) <= 2 * 3
    assert sorted(map(tuple, table.read().collect()), key=repr) == _newest(batches)
    table.optimize()
    assert len(table.manifest()["runs"]) == 1 and "Window" not in table.read()._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, table.read().collect()), key=repr) == _newest(batches)
    assert table.vacuum() and sorted(map(tuple, table.read().collect()), key=repr) == _newest(batches)


def test_empty_batches_and_tables(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), ["k"], "at")
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.add(spark.createDataFrame([], SCHEMA), 0) and not table.add(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0)
    assert table.read().collect() == [] and table.manifest()["runs"] == []
    assert table.add(spark.createDataFrame([("a", 1, "x")], SCHEMA), 0, "another writer")
    assert table.read().count() == 1


def test_a_merge_commits_on_top_of_a_batch(spark, tmp_path, monkeypatch):
    table = RunTable(spark, str(tmp_path / "t"), ["k"], "at", fanout=2)
    for n in range(2):
        table.add(spark.createDataFrame([(f"k{n}", n, "x")], SCHEMA), n)
    commit, other = table.manifests.commit, RunTable(spark, table.path, ["k"], "at", fanout=2)
    tried = []

    def slow(base, manifest):
        if not tried:
            other.add(spark.createDataFrame([("late", 1, "y")], SCHEMA), 2)  # while the merge is at work
        tried.append(base)
        return commit(base, manifest)
    monkeypatch.setattr(table.manifests, "commit", slow)
    table._merge(table.manifest()["runs"][:2], 1)
    assert len(tried) == 2 and sorted(r["k"] for r in table.read().collect()) == ["k0", "k1", "late"]
    with pytest.raises(ConcurrentWrite):
        commit(0, {"runs": []})


def test_stream_ingest_reads_few_runs_after_many_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rng, batches = random.Random(5), []
    for n in range(10):
        rows = [(k, f"2024-01-{rng.randint(10, 28)}", str(n)) for k in rng.sample("abcdefgh", 3)]
        batches.append([(k, int(day[-2:]), v) for k, day, v in rows])
        (tmp_path / "in" / f"{n:02d}.json").write_text("\n".join(json.dumps({"native_id": k, "fetched_at": at, "data": v}) for k, at, v in rows))
        if n in (5, 9):  # two runs of the job, a file a batch
            got = jobs.stream_ingest(spark, str(tmp_path / "in"), "native_id string, fetched_at string, data string",
                                     str(tmp_path / "out"), str(tmp_path / "ckpt"), max_files=1)
    table = RunTable(spark, str(tmp_path / "out"), ["native_id"], "fetched_at")
    assert len(table.manifest()["runs"]) <= 2 * 3 and list(table.manifest()["writers"].values()) == [9]
    expected = [(k, f"2024-01-{at}") for k, at, _ in _newest(batches)]
    assert sorted((r["native_id"], r["fetched_at"]) for r in got.collect()) == expected


def test_stream_dedup_over_many_files(spark, tmp_path):
    """200 files in four batches and a second run; late and null rows."""
    rng, landing = random.Random(7), tmp_path / "in"
    base, schema, files = dt.datetime(2024, 1, 1), "u long, e string, ts timestamp, big long, x double", []
    for n in range(200):
        files.append([(rng.choice([None, *range(40)]), rng.choice("ab"), rng.choice([None, base + dt.timedelta(minutes=rng.randint(0, 9999), microseconds=n)]),
                       rng.choice([None, (1 << 60) + n]), rng.choice([None, float("inf"), 0.1])) for _ in range(4)])

    def land(lot, name):
        import pyarrow as pa
        import pyarrow.parquet as pq
        landing.mkdir(exist_ok=True)
        for k, rows in enumerate(lot):
            columns = list(zip(*rows))
            pq.write_table(pa.table({"u": pa.array(columns[0], pa.int64()), "e": pa.array(columns[1]), "ts": pa.array(columns[2], pa.timestamp("us", "UTC")),
                                     "big": pa.array(columns[3], pa.int64()), "x": pa.array(columns[4], pa.float64())}), landing / f"{name}{k:03d}.parquet")

    run = lambda: jobs.stream_dedup(spark, str(landing), schema, str(tmp_path / "out"), str(tmp_path / "ckpt"), ["u", "e"])
    land(files, "a")
    got = run().collect()
    every = [r for rows in files for r in rows]
    assert len(got) == len({(r[0], r[1]) for r in every}) and all((r["u"], r["e"], r["ts"] and r["ts"], r["big"], r["x"]) in every for r in got)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    assert provider is None or "RocksDB" not in provider
    land([[(3, "a", dt.datetime(2000, 1, 1), 1, 1.0), (99, "z", base + dt.timedelta(days=1), 2, 2.0), (99, "z", base, 3, 3.0)]], "b")
    again = run().collect()  # a late row of a known key changes nothing; of a new key the earliest counts
    assert len(again) == len(got) + 1 and set(map(tuple, got)) <= set(map(tuple, again))
    assert [r["big"] for r in again if r["u"] == 99] == [3]
