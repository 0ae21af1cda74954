"""Stored and streamed results do not depend on files, batches or reruns."""

import datetime as dt
import json
import random

import pandas as pd
import pytest

from quarry.functions import html as H
from quarry.operators.graph import crawl_frontier
from quarry.operators.paragraph_chunker import ChunkSettings, pack, sentence_chunks
from quarry.sources import io
from quarry.sources.chunk_store import ChunkStore
from quarry.streaming import jobs

FILES = 200
SCHEMA = "id long, ts timestamp_ntz, value double"


@pytest.fixture(scope="module")
def events():
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 150, start + dt.timedelta(hours=rng.randint(0, 24 * 30)), float(i % 7)) for i in range(600)]
    return rows  # in no order of time, ids sent again


def land(rows, folder, first, last):
    folder.mkdir(exist_ok=True)
    for k in range(first, last):
        pd.DataFrame(rows[k::FILES], columns=["id", "ts", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / f"f{k}.parquet")


def test_daily_counts(spark, events, tmp_path):
    for first, last in ((100, FILES), (0, 100)):  # the older files come later
        land(events, tmp_path / "in", first, last)
        got = jobs.stream_daily_counts(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert sum(r["events"] for r in got.collect()) == len(events)
    assert {r["window_start"].date(): r["events"] for r in got.collect()} == {
        d: sum(e[1].date() == d for e in events) for d in {e[1].date() for e in events}}


def test_dedup(spark, events, tmp_path):
    for first, last in ((0, 90), (90, FILES)):
        land(events, tmp_path / "in", first, last)
        got = jobs.stream_dedup(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"), str(tmp_path / "ckpt"), ["id"])
    assert sorted(r["id"] for r in got.collect()) == sorted({e[0] for e in events})


def test_embargo_releases_later(spark, events, tmp_path):
    land(events, tmp_path / "in", 0, FILES)
    for cutoff in ("2024-01-10T00:00:00", "2024-01-20T12:00:00"):
        got = jobs.stream_embargo(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"), str(tmp_path / "ckpt"), cutoff)
        assert got.count() == sum(e[1] <= dt.datetime.fromisoformat(cutoff) for e in events)


def test_ingest_keeps_the_newest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, (at, data) in enumerate([("2024-01-02", "new"), ("2024-01-01", "stale")]):  # the older row is sent again later
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"native_id": "a", "fetched_at": at, "data": data}))
        got = jobs.stream_ingest(spark, str(tmp_path / "in"), "native_id string, fetched_at string, data string",
                                 str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert [r["data"] for r in got.collect()] == ["new"]


def test_upsert(spark, tmp_path):
    base = spark.createDataFrame([("c1", 1), ("c2", 2)], "chunk_id string, v int")
    twice = spark.createDataFrame([("c1", 5), ("c1", 7), ("c3", 3)], "chunk_id string, v int")
    path = str(tmp_path / "none")
    io.upsert_chunks(path, base)
    with pytest.raises(ValueError):
        io.upsert_chunks(path, twice)
    assert io.upsert_chunks(path, twice, order_col="v")["replaced"] == 1
    after = ChunkStore(spark, path).read()
    assert sorted(tuple(r) for r in after.select("chunk_id", "v").collect()) == [("c1", 7), ("c2", 2), ("c3", 3)]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        io.upsert_chunks(str(tmp_path / "broken"), base)


def test_frontier_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    got = crawl_frontier(edges, spark.createDataFrame([(0,)], "node long"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, i) for i in range(21)]


def test_long_paragraph_obeys_the_limit():
    s = ChunkSettings(target_tokens=500, min_tokens=100, max_tokens=900, header_overhead_tokens=150)
    chunks = pack("One two three four. " * 12_000, s)
    assert max(n for _, n in chunks) <= 750 and len(chunks) > 60
    s = ChunkSettings(max_tokens=4, overlap_tokens=1, embed_metadata=False)
    assert sentence_chunks("a b. c d. e f g h i j.", 4, s) == [("a b. c d.", 4), ("e f g h", 4), ("h i j.", 3), ("j.", 1)]


def test_html_depth_and_structure():
    deep = "<div>" * 1500 + "all of it"
    assert H.html_to_markdown(deep) == "all of it" and "all of it" in H.strip_noise(deep)
    assert H.text_of(H.parse(deep)) == "all of it"
    assert H.html_to_markdown("<p>one<p>two") == "one\n\ntwo"
    assert H.html_to_markdown("<ul><li>a<ul><li>b</ul><li>c</ul>") == "- a\n  - b\n- c"
    assert H.html_to_markdown('<div>one <b>two</b> <a href="/x">three</a></div>') == "one **two** [three](/x)"


def test_html_functions_are_linear_in_the_page():
    import time
    pages = {"lists": "<ul><li>a" * 22_000, "inline": "<b>x " * 40_000, "ends": "<i>" * 30_000 + "<p></p></x>" * 10_000,
             "blocks in inline": "<b><i>" * 15_000 + "<p>x" * 15_000, "tables": "<table><tr><td>a" * 12_000, "tags": "<a " * 70_000,
             "less than": "x < y <z " * 22_000, "divs": "<div>" * 40_000}
    for name, page in pages.items():
        t0 = time.process_time()
        H.html_to_markdown(page), H.strip_noise(page)
        assert time.process_time() - t0 < 6, name  # the quadratic forms took minutes


def test_html_marks_and_implied_ends():
    md = H.html_to_markdown
    assert md("<p> a <b> b <i> c </i> </b> d<em> </em>e</p>") == "a **b *c*** d e"
    assert md("<b><b> x</b> y </b>") == "****x** y**" and md("<p><b></b><a href='/u'> <b>k</b> </a></p>") == "[**k**](/u)"
    assert md("<ul><li>a<div>b<ol><li>c</ol></div><li><p>d<p>e<li>f</ul>") == "- a b\n  1. c\n- d e\n- f"
    assert md("<ul>loose<li>a</ul>") == "loose\n- a"
    assert md("<table><tr><td>a<table><tr><td>b</table><td>c</table>") == "| a | c |\n|---|---|\n| b |"
    assert md("<p>1 < 2</p> 3 <4") == "1 < 2\n\n3 <4"
