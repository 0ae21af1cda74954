"""Detail view, index rows, outcomes of the gate, listing totals, names of
tabular entries, token counters, and the config import by value."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import quality as Q
from quarry.operators import relational as R
from quarry.operators.counting import with_token_count
from quarry.sources import io
from tests.conftest import SF


def test_document_detail(spark):
    schema = ("NativeId string, Title string, Content string, OrganizationName string, CaseID string, "
              "Attachments array<struct<NativeId: string, Title: string, FileURI: string>>")
    d = spark.createDataFrame([("A", "", None, None, "c", [("n", "t", None), (None, None, "u")]), ("B", "T", "x", "org", None, None),
                               ("C", None, "", "org", None, [])], schema)
    got = {r["native_id"]: r for r in R.document_detail(d).collect()}
    assert got["A"]["title"] == got["C"]["title"] == "Untitled" and got["A"]["content"] == "" and got["A"]["organization"] is None
    assert [tuple(a) for a in got["A"]["attachments"]] == [("n", "t", None, None, None, None), (None, None, "u", None, None, None)]
    assert got["B"]["attachments"] is None and got["C"]["attachments"] == []
    assert tuple(got["B"]["organization"]) == (None, "org") and tuple(got["A"]["metadata"]) == ("c", None)


def test_chunk_index_rows(spark):
    c = spark.createDataFrame([("a_chunk_0", "a", 0, None, [1.0], None, "drop")],
                              "chunk_id string, native_id string, chunk_index int, text string, embedding array<double>, case_id string, metadata string")
    row = R.chunk_index_rows(c, F.lit("k"), ["case_id", "absent", "native_id"]).first()
    assert (row["collection"], row["id"], row["text"], row["vector"]) == ("k", "a_chunk_0", "", [1.0])
    assert row["metadata"].asDict() == {"native_id": "a", "chunk_index": 0, "case_id": ""} and row["indexed_at"] is not None


def test_content_outcome_in_order(spark):
    rows = [(True, None, None, 0, 0, "skipped"), (None, None, None, 1, 1, "failed: missing"), (False, "", "", 0, 0, "failed: no content"),
            (False, "x", " \n", 0, 0, "failed: conversion empty"), (False, "x", None, 3, 3, "failed: conversion empty"),
            (None, "x", "y", None, None, "failed: no chunks"), (None, "x", "y", 2, None, "failed: embedding"),
            (None, "x", "y", 2, 0, "failed: embedding"), (None, "x", "y", 2, 1, "success")]
    d = spark.createDataFrame(rows, "known boolean, content string, markdown string, chunks long, embedded long, want string")
    got = d.select("want", Q.content_outcome("known", "content", "markdown", "chunks", "embedded").alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got) and len(got) == len(rows)


def test_listing_totals(spark):
    schema = "s string, decisions array<struct<NativeId: string>>, count long"
    pages = spark.createDataFrame([("a", [("1",), ("2",)], 3), ("a", [("3",)], 0), ("b", [("1",)], 5), ("c", None, None), (None, [], 1)], schema)
    got = {r["s"]: (r["returned"], r["total"], r["complete"]) for r in io.listing_totals(pages, ["s"]).collect()}
    assert got == {"a": (3, 3, True), "b": (1, 5, False), "c": (0, 0, True), None: (0, 1, False)}
    assert io.listing_totals(pages.limit(0), ["s"]).count() == 0


def test_unique_names(spark):
    rows = [("hot", f"{i:04d}") for i in range(400)] + [("hot", "0000")] * 3 + [("one", "x"), ("hot_2", "y"), ("hot_2", "z"), (None, "n")]
    entries = spark.createDataFrame(rows, "file_name string, content string").repartition(7)
    got = io.unique_names(entries).collect()
    names = [r["file_name"] for r in got]
    assert len(got) == len(rows) and len(set(names)) == len(names)
    assert sorted(r["content"] for r in got) == sorted(c for _, c in rows)
    assert {"hot", "one", "hot_2", "hot_403", "hot_2_2"} <= set(names)
    assert next(r["content"] for r in got if r["file_name"] == "hot") == "0000"
    assert io.unique_names(entries.limit(0)).count() == 0


def test_unique_names_meet_no_name_made_to_look_like_them(spark):
    rows = [("hot", str(i)) for i in range(4)] + [("hot_2", "x"), ("hot_3", "y"), ("hot_2_nn", "a"), ("", "e"), ("", "f"), ("_2", "g")]
    rows += [(f"hot_{k}_{n}_{at}", "z") for k in (2, 3) for n in ("n", "nn", "nnn") for at in range(40)]
    rows += [("hot_2_nnn", str(i)) for i in range(40)]
    entries = spark.createDataFrame(rows, "file_name string, content string").repartition(5)
    got = [r["file_name"] for r in io.unique_names(entries).collect()]
    assert len(set(got)) == len(got) == len(rows)
    assert {name for name, _ in rows} <= set(got)


def test_entries_without_a_name_column_are_numbered(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 1), ("c", None), ("c", None)], "t string, v int").repartition(3)
    got = io.tabular_entries(rows, ["v", "absent"], "t", None).collect()
    assert {(r["content"], r["file_name"]) for r in got} == {
        ("a\n\n\n\nv: 1", "unknown_entry_1"), ("b\n\n\n\nv: 2", "unknown_entry_2"),
        ("c\n\n\n\nv: -", "unknown_entry_3"), ("c\n\n\n\nv: -", "unknown_entry_4")}
    kept = io.tabular_entries(rows, ["v"], "t", None, filter_field="t", filter_value="b").collect()
    assert [r["file_name"] for r in kept] == ["unknown_entry_2"]


def test_token_counters(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "a b, c!"), (4, "x " * 30_000), (5, " ")], "id int, text string")

    def count(counter):
        return {r["id"]: r["n"] for r in with_token_count(d, "text", counter, "n").collect()}

    assert count(None) == {1: 0, 2: 0, 3: 3, 4: 30_000, 5: 0}
    assert count(re.compile(r"\w|[,!]")) == {1: 0, 2: 0, 3: 5, 4: 30_000, 5: 0}
    assert count(lambda texts: [len(t) for t in texts]) == {1: 0, 2: 0, 3: 7, 4: 60_000, 5: 1}
    with pytest.raises(Exception, match="0 counts of 3 texts"):
        with_token_count(d.repartition(1), "text", lambda texts: []).collect()


def test_config_import_by_value(spark):
    from quarry.plans import catalog
    got = catalog.queries()["import_from_config"](spark, SF)
    customers, events = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("customer", "events"))
    by = {c: [(r["file_name"], r["content"]) for r in got.where(F.col("config") == c).collect()] for c in ("csv_excel", "web", "events_api")}
    want = sorted((f"excel_{r['c_name']}".replace(" ", "_"), f"{r['c_name']}\n\n\n\nc_mktsegment: {r['c_mktsegment']} \n\nc_acctbal: {r['c_acctbal']}")
                  for r in customers.collect())
    assert sorted(by["csv_excel"]) == want or sorted((n.removesuffix(".md").removesuffix(".txt"), c) for n, c in by["csv_excel"]) == want
    assert len(by["events_api"]) == events.count() and all(n.startswith("event_") for n, _ in by["events_api"])
    assert len(by["web"]) > 0 and all(n.startswith("web_") and c for n, c in by["web"])
