"""The ingestion job against a version by hand, and its parts' failures."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators.embedding import embed_texts
from quarry.operators.ledger import failure_streak, ingest_batch_stats, retry_rollup
from quarry.operators.paragraph_chunker import ChunkSettings, pack
from quarry.operators.relational import attachment_metadata, delete_attachments, delete_counts, delete_document
from quarry.operators.search_filters import metadata_filter
from quarry.plans.ingest import ingest
from quarry.sources import io
from quarry.sources.chunk_store import ChunkStore
from quarry.sources.decisions import DECISION_SCHEMA

SETTINGS = ChunkSettings(60, 30, 80, 10, 20)
DECISIONS = ("NativeId string, Title string, Content string, DateDecision string, is_html boolean, ClassificationTitle string,"
             "ClassificationCode string, OrganizationName string, CaseID string, Section string")


def _decision(name, content, day="2024-01-02", is_html=False):
    return (name, "t " + name, content, day, is_html, None, None, None, None, None)


def _embedder(texts):
    if any("poison" in t for t in texts):
        raise ValueError("poison")
    return [[float(len(t)), 1.0] for t in texts]


def test_ingest_outcomes_chunks_and_export(spark, tmp_path):
    long = "\n".join(" ".join(f"w{i}_{k}" for k in range(25)) + "." for i in range(20))
    rows = [_decision("plain", long), _decision("html", "<h1>Head</h1><p>One</p><p>Two <b>three</b></p>", is_html=True),
            _decision("known", "text"), _decision("none", None), _decision("blank", " \n "), _decision("bad-page", "<br>", is_html=True),
            _decision("control", "bell\x07"), _decision("poisoned", "poison here"), _decision("early", "x", "2023-12-31"),
            _decision("last", "x y", "2024-01-09T23:59:59.000"), _decision("late", "x", "2024-01-10")]
    atts = [("plain", "att_1", "u", "Julkinen", None, "attached words"), ("plain", "att_2", "u", "Salainen", None, "secret"),
            ("plain", "att_3", None, None, None, "no address"), ("plain", "att_4", "u", None, None, None),
            ("known", "att_1", "u", None, None, "of a skipped one"), ("html", "att_1", "u", None, None, "poison")]
    decisions = spark.createDataFrame(rows, DECISIONS)
    attachments = spark.createDataFrame(atts, "decision_native_id string, attachment_native_id string, FileURI string,"
                                              "PublicityClass string, PersonalData string, text string")
    known = spark.createDataFrame([("known",), ("known",)], "NativeId string")
    store, export = str(tmp_path / "store"), str(tmp_path / "export")
    out = ingest(decisions, known, attachments, "2024-01-01", "2024-01-10", _embedder, model="m",
                 store_path=store, export_path=export, settings=SETTINGS)
    got = {r["NativeId"]: r for r in out.collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {
        "plain": "successful", "html": "successful", "known": "skipped", "none": "failed: no content",
        "blank": "failed: conversion empty", "bad-page": "failed: conversion empty", "control": "failed: conversion empty",
        "poisoned": "failed: embedding", "last": "successful"}
    assert got["plain"]["chunks"] == len(pack(long.replace("\n", "\n\n"), SETTINGS)) > 3
    assert (got["plain"]["attachments"], got["plain"]["attachment_chunks"]) == (1, 1)
    assert (got["html"]["chunks"], got["html"]["attachments"]) == (1, 0)
    assert got["poisoned"]["failed_chunks"] == 1
    stored = {r["chunk_id"]: r for r in ChunkStore(spark, store).read().collect()}
    rows = spark.read.parquet(export).collect()
    assert {r["chunk_id"] for r in rows} == set(stored)
    plain = sorted((r["chunk_index"], r["text"]) for r in stored.values() if r["NativeId"] == "plain")
    assert len(plain) == got["plain"]["chunks"] and all(stored[c]["embedding"][0] == len(stored[c]["text"]) for c in stored)
    assert {r["decision_native_id"] for r in stored.values()} == {"plain", "html", "last"}
    # a second run skips what the store holds and adds to it
    more = decisions.union(spark.createDataFrame([_decision("later", "some other words")], DECISIONS))
    again = ingest(more, None, attachments, "2024-01-01", "2024-01-10", _embedder, model="m",
                   store_path=store, export_path=export + "2", settings=SETTINGS)
    second = {r["NativeId"]: r["outcome"] for r in again.collect()}
    assert [second[k] for k in ("plain", "html", "last", "later", "poisoned")] == ["skipped"] * 3 + ["successful", "failed: embedding"]
    after = {r["chunk_id"]: r for r in ChunkStore(spark, store).read().collect()}
    assert {k: after[k] for k in stored} == stored and {after[k]["NativeId"] for k in set(after) - set(stored)} == {"known", "known_att_1", "later"}
    assert len(rows) == sum(r["chunks"] + r["attachment_chunks"] for r in got.values())
    assert len({r["chunk_id"] for r in rows}) == len(rows) and {str(r["batch_day"]) for r in rows} == {"2024-01-02", "2024-01-09"}
    stats = {r["batch_day"]: r for r in ingest_batch_stats(out).collect()}
    day = stats["2024-01-02"]
    assert [day[c] for c in ("total", "processed", "successful", "failed", "skipped", "attachments")] == [8, 7, 2, 5, 1, 1]


def test_ingest_of_nothing(spark, tmp_path):
    decisions = spark.createDataFrame([], DECISIONS)
    attachments = spark.createDataFrame([], "decision_native_id string, attachment_native_id string, FileURI string,"
                                            "PublicityClass string, PersonalData string, text string")
    out = ingest(decisions, decisions.select("NativeId"), attachments, "2024-01-01", "2024-02-01", _embedder, model="m",
                 store_path=str(tmp_path / "s"), export_path=str(tmp_path / "e"))
    assert out.collect() == []


def test_embed_texts_keeps_failed_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "poison", " ", None, "b c"])], "id int, t string").coalesce(1)
    got = {r["id"]: r for r in embed_texts(df, "t", "id", _embedder, batch_size=10, keep=("t",)).collect()}
    assert {i for i, r in got.items() if r["embedding"]} == {0, 4}
    assert got[1]["error"] == "ValueError: poison" and got[2]["error"] == got[3]["error"] == "empty text"
    assert got[4]["tokens_used"] == 2 and got[4]["t"] == "b c" and got[4]["error"] is None


def test_read_indented_documents(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"d{k}.json").write_text(json.dumps({"NativeId": f"D{k}", "Attachments": [{"Title": "a"}]}, indent=2))
    (tmp_path / "broken.json").write_text('{"NativeId": "D9",\n')
    back = io.read_documents(spark, str(tmp_path), DECISION_SCHEMA, multi_line=True)
    assert back.count() == 3
    assert sorted(r["NativeId"] for r in back.collect()) == ["D0", "D1", "D2"]


def test_read_eval_pairs(spark, tmp_path):
    for k, text in enumerate([" q1 \n---\n a1\n", "no separator", "a --- b --- c"]):
        (tmp_path / f"p{k}.txt").write_text(text)
    got = {r["file"][-6:-4]: r for r in io.read_eval_pairs(spark, str(tmp_path)).collect()}
    assert (got["p0"]["question"], got["p0"]["answer"], got["p0"]["error"]) == ("q1", "a1", None)
    assert all(got[k]["error"] and got[k]["question"] is None for k in ("p1", "p2"))


def test_attachment_metadata_falls_back_to_the_position(spark):
    df = spark.createDataFrame([("P", "T", [("a", None, None), ("b", 7, None), ("c", 0, ""), ("d", 1, "N")])],
                               "NativeId string, Title string, Attachments array<struct<Title:string, AttachmentNumber:int, NativeId:string>>")
    for c in ("CaseID", "Section", "ClassificationCode", "ClassificationTitle", "DateDecision", "OrganizationName"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    att = F.transform("Attachments", lambda a: a.withField("Type", F.lit("x")).withField("FileURI", F.lit("u")))
    rows = attachment_metadata(df.withColumn("Attachments", att)).orderBy("attachment_title").collect()
    assert [r["attachment_native_id"] for r in rows] == ["att_1", "att_7", "att_3", "N"]
    assert all(r["is_attachment"] and r["native_id"] == "P" and r["name"] == "T.md" for r in rows)


def test_deletes_count_what_they_remove(spark):
    store = spark.createDataFrame([("a", None, False), ("a1", "a", True), ("b", None, False), ("c1", "c", True), (None, None, False)],
                                  "native_id string, decision_native_id string, is_attachment boolean")
    ids = spark.createDataFrame([("a",), ("missing",)], "id string")
    kept = delete_document(store, ids)
    assert sorted(str(r["native_id"]) for r in kept.collect()) == ["None", "b", "c1"]
    assert tuple(delete_counts(store, kept, ids).first()) == (2, 2, 0, 2)
    assert sorted(str(r["native_id"]) for r in delete_attachments(store, ids).collect()) == ["None", "a", "b", "c1"]


def test_ledgers_of_ties_and_null_keys(spark):
    rows = [("k", 1, 1, False), ("k", 1, 2, True), ("k", 2, 1, False), (None, 1, 1, False), ("f", 3, 1, False), ("f", 4, 1, False)]
    df = spark.createDataFrame(rows, "id string, ts int, n int, ok boolean")
    got = {r["id"]: tuple(r)[1:] for r in retry_rollup(df, "id", ["ts", "n"]).collect()}
    assert got == {"k": (2, 3, "recovered", 2), None: (None, 1, "failed", 1), "f": (None, 2, "failed", 2)}
    assert {r["id"]: r["streak"] for r in failure_streak(df, "id", "ts").collect()} == {"k": 1, None: 1, "f": 2}


@pytest.mark.parametrize("lo,hi,want", [("2024-01-02", "2024-01-03", {1, 2, 3}), (None, "2024-01-02", {0, 1, 2}), ("2024-01-04", None, {4})])
def test_metadata_filter_days(spark, lo, hi, want):
    days = ["2024-01-01T23:59:59", "2024-01-02", "2024-01-02T10:00:00", "2024-01-03T23:59:59.999", "2024-01-04", None]
    df = spark.createDataFrame(list(enumerate(days)), "id int, d string")
    assert {r["id"] for r in metadata_filter(df, "d", lo, hi).collect()} == want


def test_event_feed_and_unique_names(spark):
    event = {"name": {"fi": "Konsertti"}, "start_time": "2024-05-01T18:00:00", "end_time": "2024-05-01T20:30:00",
             "location": {"@id": "http://x/1", "name": {"fi": "Talo"}, "street_address": None}, "description": {"fi": "a"}}
    other = {**event, "description": {"fi": "b"}}
    raw = spark.createDataFrame([(json.dumps({"data": [event, other, {}]}),), ("{}",), ("not json",), (None,)], "value string")
    rows = io.event_entries(io.event_feed(raw)).orderBy("content").collect()
    assert len(rows) == 3 and len({r["file_name"] for r in rows}) == 3
    assert any("Aika: 18:00 - 20:30" in r["content"] and "No Address" in r["content"] for r in rows)
    assert any("No Title" in r["content"] for r in rows)


def test_publish_all_isolates_failures(spark, tmp_path):
    from quarry.plans.publish import publish_all
    ok = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "z")], "file_name string, content string")

    def broken(s, c):
        raise OSError("gone")
    sources = {"csv_excel": lambda s, c: ok, "web": broken, "events_api": lambda s, c: ok.limit(0)}
    configs = [{"type": t, "collection": t} for t in ("web", "csv_excel", "events_api", "ftp")]
    got = {r["type"]: (r["entries"], r["error"]) for r in publish_all(spark, configs, sources, str(tmp_path / "k")).collect()}
    assert got["csv_excel"] == (2, None) and got["events_api"] == (0, None)
    assert got["web"] == (0, "OSError: gone") and got["ftp"][1].startswith("ValueError")
    checked = {r["type"]: r["error"] for r in publish_all(spark, configs, sources, str(tmp_path / "v"), verify_only=True).collect()}
    assert checked["csv_excel"] is None and "no entry" in checked["events_api"] and not (tmp_path / "v").exists()


def test_publishing_nothing_leaves_nothing(spark, tmp_path):
    from quarry.plans.publish import full_refresh_publish
    entries = spark.createDataFrame([("a", "x y"), ("b", "z")], "doc_id string, content string")
    path = str(tmp_path / "k")
    for name in ("one two/three", "other"):
        assert tuple(full_refresh_publish(entries, path, name).first()) == (name, 2, 1.5)
    assert tuple(full_refresh_publish(entries.limit(0), path, "one two/three").first()) == ("one two/three", 0, 0.0)
    left = spark.read.schema("name string, content string, tokens long, collection string").parquet(path)
    assert {r["collection"] for r in left.collect()} == {"other"} and left.count() == 2


def test_a_window_run_again_without_rows_becomes_empty(spark, tmp_path):
    rows = [("a", "2024-01-01", "{}", "s1", "e1"), ("b", "2024-01-02", "{}", "s 2:0", "e2")]
    df = spark.createDataFrame(rows, "native_id string, fetched_at string, data string, batch_start string, batch_end string")
    path = str(tmp_path / "raw")
    io.write_raw_archive(df, path)
    io.write_raw_archive(df.where("native_id = 'a'"), path, windows=[("s1", "e1"), ("s 2:0", "e2"), ("s3", "e3")])
    assert [r["native_id"] for r in io.read_raw_archive(spark, path).collect()] == ["a"]
    vectors = spark.createDataFrame([("c1", "a", [1.0], "w1"), ("c2", "a", [1.0], "w2")],
                                    "chunk_id string, native_id string, embedding array<double>, window string")
    path = str(tmp_path / "emb")
    io.write_embeddings(vectors, path, "m")
    assert [r["chunk_id"] for r in io.write_embeddings(vectors.limit(0), path, "m", windows=["w1"]).collect()] == ["c2"]
