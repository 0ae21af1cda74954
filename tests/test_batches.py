"""Python stages hand on bounded parts of an Arrow batch, with the same rows."""

import datetime as dt

import pyarrow as pa
from pyspark.sql import types as T

from quarry.functions import html as H
from quarry.operators import html_jobs
from quarry.operators.batches import parts
from quarry.operators.embedding import embed_texts
from quarry.operators.paragraph_chunker import ChunkSettings, paragraph_chunks, sentence_chunks

MB = 1 << 20


class Captured:
    """Stands for a DataFrame and keeps the function that its batches go to."""

    def __init__(self, **kinds):
        self.schema = T.StructType([T.StructField(n, k) for n, k in kinds.items()])

    def select(self, *_):
        return self

    def select(self, *_):
        return self

    def mapInArrow(self, run, _schema):
        self.run = run
        return self


def test_parts_are_bounded_and_whole():
    batch = pa.RecordBatch.from_pydict({"k": list(range(6)), "t": ["a" * MB, None, "b" * (3 * MB), "", "c" * 10, "d" * MB]})
    cut = list(parts(batch))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))
    assert [p.num_rows for p in cut] == [1, 1, 1, 2, 1]
    small = pa.RecordBatch.from_pydict({"t": [None] * 50_000})
    assert sum(p.num_rows for p in parts(small)) == 50_000 and max(p.num_rows for p in parts(small)) < 11_000
    assert list(parts(batch.slice(0, 0))) == []


def test_html_in_parts_of_a_batch():
    pages = [f"<h1>T{k}</h1><p>" + "word " * 2_000 + "</p>" for k in range(1_000)]
    held = html_jobs._map_html(Captured(k=T.LongType(), html=T.StringType()), ("html",), lambda p: (H.html_to_markdown(p),),
                               [T.StructField("_md", T.StringType())])
    out = list(held.run(iter([pa.RecordBatch.from_pydict({"k": list(range(1_000)), "html": pages})])))
    assert max(b.nbytes for b in out) < 3 * MB
    table = pa.Table.from_batches(out)
    assert table.column("k").to_pylist() == list(range(1_000)) and table.column("html").to_pylist() == pages
    assert table.column("_md").to_pylist()[::100] == [H.html_to_markdown(p) for p in pages[::100]]


def test_html_jobs_pass_every_column_type(spark):
    """Other columns come through as they were, nulls and repeated rows too."""
    row = (1, "<h1> A </h1><a href='/x'>b</a>", dt.datetime(2024, 1, 2, 3), dt.date(2024, 1, 2), {"a": [1, 2]}, b"x", "http://h/p")
    df = spark.createDataFrame([row, row, (None, None, None, None, None, None, None)],
                               "k int, html string, at timestamp, day date, m map<string,array<int>>, b binary, url string").coalesce(1)
    got = html_jobs.select_text(df, "html", {"h1": "h1"}).collect()
    assert [tuple(r)[:7] for r in got] == [tuple(r) for r in df.collect()] and [r["h1"] for r in got] == ["A", "A", None]
    assert [r["link"] for r in html_jobs.extract_links(df).collect()] == ["http://h/x"] * 2
    md = html_jobs.html_to_markdown(df.selectExpr("k", "html", "k IS NOT NULL AS f"), "html", is_html="f").collect()
    assert [r["markdown"] for r in md] == [H.html_to_markdown(row[1]) + "\n"] * 2 + [""]


def test_chunks_in_parts_of_a_batch():
    texts = [f"{k} one two. " + "three four. " * 400 for k in range(2_000)]
    s = ChunkSettings(max_tokens=50, overlap_tokens=5, embed_metadata=False)
    held = paragraph_chunks(Captured(id=T.LongType(), t=T.StringType()), "t", "id", s, long_paragraph_only=True)
    out = list(held.run(iter([pa.RecordBatch.from_pydict({"id": list(range(2_000)), "t": texts})])))
    assert max(b.nbytes for b in out) < 4 * MB
    want = [(k, i, f"{k}_chunk_{i}", *c) for k, t in enumerate(texts) for i, c in enumerate(sentence_chunks(t, 50, s))]
    assert [tuple(r.values()) for r in pa.Table.from_batches(out).to_pylist()] == want


def test_chunks_of_nulls_and_other_columns(spark):
    rows = [(7, "a b", dt.datetime(2024, 1, 2), "H"), (7, "a b", None, None), (None, "c", None, None), (9, None, None, None), (9, " ", None, None)]
    df = spark.createDataFrame(rows, "id long, t string, at timestamp, h string").coalesce(1)
    got = paragraph_chunks(df, "t", "id", header_col="h", keep=("at",)).collect()
    assert [tuple(r) for r in got] == [(rows[0][2], 7, 0, "7_chunk_0", "H\n\na b", 3), (None, 7, 0, "7_chunk_0", "a b", 2),
                                       (None, None, 0, "None_chunk_0", "c", 1)]


def test_embeddings_in_batches_of_texts():
    seen = []

    def embed(texts):
        seen.append(list(texts))
        return [[float(len(t))] * 64 for t in texts]

    texts = [None if k % 7 == 3 else " " if k % 7 == 5 else f"{k} " + "x" * 5_000 for k in range(3_000)]
    held = embed_texts(Captured(id=T.LongType(), t=T.StringType()), "t", "id", embed, batch_size=100, keep=("t",))
    out = list(held.run(iter([pa.RecordBatch.from_pydict({"id": list(range(3_000)), "t": texts})])))
    assert max(b.nbytes for b in out) < MB
    filled = [t for t in texts if t and t.strip()]
    assert seen == [filled[at:at + 100] for at in range(0, len(filled), 100)]  # batches are as full as before
    rows = pa.Table.from_batches(out).to_pylist()
    assert [(r["id"], r["t"]) for r in rows] == list(enumerate(texts))
    assert [r["embedding"] for r in rows] == [[float(len(t))] * 64 if t and t.strip() else None for t in texts]
    assert {r["error"] for r in rows} == {None, "empty text"}
