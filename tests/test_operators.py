"""Golden and property tests for the operators without a SQL oracle, and for
the cases the reference's own tests pin down."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import text as T
from quarry.operators import chunking
from quarry.operators.paragraph_chunker import ChunkSettings, pack, paragraph_chunks
from tests.conftest import SF


def _one(spark, expr, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


# ---------------------------------------------------------------- chunking
def test_token_windows_hand_worked(spark):
    text = " ".join(f"w{i}" for i in range(250))
    df = spark.createDataFrame([("d", text)], "id string, t string")
    rows = chunking.token_window_chunks(df, "t", "id", max_tokens=100, overlap=20).orderBy("chunk_index").collect()
    starts = [int(r["text"].split()[0][1:]) for r in rows]
    assert starts == [0, 80, 160, 230]
    assert [r["token_count"] for r in rows] == [100, 100, 90, 20]


def test_token_windows_overlap_not_smaller(spark):
    df = spark.createDataFrame([("d", " ".join(["x"] * 25))], "id string, t string")
    rows = chunking.token_window_chunks(df, "t", "id", max_tokens=10, overlap=10).collect()
    assert [r["token_count"] for r in rows] == [10, 10, 5]


def test_paragraph_chunker_cases():
    s = ChunkSettings(target_tokens=100, min_tokens=50, max_tokens=150, overlap_tokens=20, header_overhead_tokens=75)
    assert pack("", s) == []
    out = pack("Paragraph one.\n\nParagraph two.\n\nParagraph three.", s)
    assert len(out) >= 1 and all(n > 0 for _, n in out)
    long = " ".join(["word"] * 500)
    assert all(n <= s.max_tokens for _, n in pack(long, s))


def test_paragraph_chunker_ids_and_header(spark):
    s = ChunkSettings(target_tokens=100, min_tokens=50, max_tokens=150, overlap_tokens=20, header_overhead_tokens=75)
    df = spark.createDataFrame([("doc_123", "Test content", "--- Dokumentin konteksti ---\nPäätös ID: doc_123\n---")],
                               "id string, t string, h string")
    rows = paragraph_chunks(df, "t", "id", s, header_col="h").collect()
    assert rows[0]["chunk_id"] == "doc_123_chunk_0"
    assert rows[0]["text"].startswith("--- Dokumentin konteksti ---") and rows[0]["text"].endswith("Test content")


def test_metadata_header(spark):
    df = spark.createDataFrame([("T", None, "Hallinto", "01", None, "2024-12-31T23:59:59.000", "", "10")],
                               "ti string, ni string, ct string, cc string, org string, dd string, cid string, sec string")
    h = df.select(T.metadata_header("ti", "ni", "ct", "cc", "org", "dd", "cid", "sec").alias("h")).first()["h"]
    lines = h.split("\n")
    assert lines[0] == "--- Dokumentin konteksti ---" and lines[-1] == "---"
    assert "Päivämäärä: 2024-12-31" in lines and "None" not in h
    assert all(not ln.endswith(": ") for ln in lines)


# ---------------------------------------------------------------- text
def test_clean_markdown(spark):
    assert _one(spark, T.clean_markdown("t"), "Line 1\n\n\n\n\nLine 2  \n") == "Line 1\n\nLine 2\n"
    assert _one(spark, T.clean_markdown("t"), "") == ""


@pytest.mark.parametrize("value,expected", [
    ("010190-123A", "[HETU]"), ("010190+", "[HETU]"), ("010190abc", "[HETU]"), ("010190", "[HETU]"),
    ("010190-12", "[HETU]12"), ("0101901234", "[HETU]"), ("3502411666", "[HETU]"),
    ("410190-123A", "410190-123A"), ("019990-123A", "019990-123A"), ("ä010190-123A", "ä010190-123A"),
])
def test_redact_hetu(spark, value, expected):
    assert _one(spark, T.redact_pii("t"), value) == expected


@pytest.mark.parametrize("value,expected", [
    ("040 123 4567", "[PUHELIN]"), ("09 310 13700", "[PUHELIN]"), ("+358401234567", "+[PUHELIN]"),
    ("(09) 12345", "([PUHELIN]"),
])
def test_redact_phone(spark, value, expected):
    assert _one(spark, T.redact_pii("t", "hetu_phone"), value) == expected


@pytest.mark.parametrize("uri,ext", [("file.pdf", ".pdf"), ("file.docx", ".docx"), ("file.PDF?param=value", ".pdf"),
                                     ("file", ".bin"), (".bashrc", ".bin")])
def test_uri_extension(spark, uri, ext):
    assert _one(spark, T.uri_extension("t"), uri) == ext


def test_camel_space(spark):
    assert _one(spark, T.camel_space("t"), "USA") == "U S A"
    assert _one(spark, T.camel_space("t"), "helloWorld") == "hello World"


# ---------------------------------------------------------------- dates, gates, roll-ups
def test_date_batches(spark):
    from quarry.functions.dates import date_batches
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-15 00:00:00")], "s string, e string") \
        .select(F.col("s").cast("timestamp").alias("s"), F.col("e").cast("timestamp").alias("e"))
    rows = date_batches(df, "s", "e", 7).collect()
    assert len(rows) == 2 and rows[0]["weeks"] == 2


def test_attachment_gate(spark):
    from quarry.operators.quality import attachment_ok
    rows = [("https://example.com/test.pdf", "Julkinen", "Ei sisällä henkilötietoja", True),
            ("https://example.com/private.pdf", "Salainen", "Ei sisällä henkilötietoja", False),
            ("https://example.com/personal.pdf", "Julkinen", "Sisältää henkilötietoja", False),
            (None, "Julkinen", "Ei sisällä henkilötietoja", False),
            ("https://example.com/test.pdf", None, None, True)]
    df = spark.createDataFrame(rows, "u string, p string, d string, want boolean")
    got = df.select(attachment_ok("u", "p", "d").alias("ok"), "want").collect()
    assert all(r["ok"] == r["want"] for r in got)


def test_outage_rollup_scenario(spark):
    from quarry.operators.ledger import outage_rollup
    rows = [("2024-01-01", 1, True), ("2024-01-01", 2, True), ("2024-01-01", 3, False),
            ("2024-01-08", 1, False),
            ("2024-01-15", 1, True), ("2024-01-15", 2, True), ("2024-01-15", 3, True)]
    df = spark.createDataFrame(rows, "b string, attempt int, outage boolean").withColumn("id", F.col("attempt"))
    r = {x["b"]: x for x in outage_rollup(df, "b", ["attempt", "id"]).collect()}
    assert sum(1 for x in r.values() if x["outages"] > 0) == 2
    assert sum(x["retries_used"] for x in r.values()) == 4
    assert r["2024-01-01"]["status"] == "recovered" and r["2024-01-15"]["status"] == "failed"


# ---------------------------------------------------------------- html
def test_html_noise_and_markdown():
    html = ('<div><h1>Otsikko</h1><section class="MuutoksenhakuohjeetSektio"><p>ohje</p>'
            '<section><p>inner</p></section></section><p>Teksti <img src="x.png"> jatkuu</p>'
            '<ul><li>a</li><li>b</li></ul><table><tr><th>k</th></tr><tr><td>v</td></tr></table></div>')
    md = H.html_to_markdown(html)
    assert "# Otsikko" in md and "ohje" not in md and "inner" not in md and "- a\n- b" in md
    assert "| k |" in md and "| v |" in md
    assert H.html_to_markdown("") == ""
    assert "Unclosed" in H.html_to_markdown("<p>Unclosed paragraph")
    assert "\\" not in H.strip_noise("<p>a\\b</p>")


def test_page_entries(spark):
    from quarry.operators.html_jobs import page_entries
    df = spark.createDataFrame([(1, "http://x.example.com/a?q=1",
                                 "<html><h1>Hello World</h1><article>SomeText here</article></html>")],
                               "page_id long, url string, html string")
    r = page_entries(df).first()
    assert r["title"] == "Hello World"
    assert r["content"].startswith("Hello  World\n\n") and "Some Text" in r["content"]


# ---------------------------------------------------------------- retrieval
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_approx_knn_recall(spark, sf):
    from quarry.operators import retrieval
    from quarry.plans import search
    emb = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    q = search.query_vectors(spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet"))
    exact = retrieval.knn_search(emb, q, 10, qid="item_id", cid="vec_id").select("item_id", "vec_id").collect()
    approx = retrieval.approx_knn(emb, q, 10, qid="item_id", cid="vec_id").select("item_id", "vec_id").collect()
    e, a = {tuple(r) for r in exact}, {tuple(r) for r in approx}
    assert len(a) == len(approx) == len(exact)
    assert len(e & a) / len(e) >= 0.9


def test_knn_many_blocks_equal_one(spark):
    from quarry.operators import retrieval, threshold
    from quarry.plans import search
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = search.query_vectors(spark.read.parquet(f"{SF}/benchmark.parquet"))
    names = {"qid": "item_id", "cid": "vec_id"}
    small = (64 * 8 + 64) * 15  # 15 queries a block
    for run in (lambda **o: retrieval.knn_search(emb, q, 3, **names, **o),
                lambda **o: threshold.score_pairs(emb, q, 0.2, **names, **o)):
        assert sorted(map(tuple, run().collect())) == sorted(map(tuple, run(max_block_bytes=small).collect()))


def test_knn_skips_what_cannot_be_scored(spark):
    from quarry.operators import retrieval
    schema = "chunk_id string, embedding array<double>"
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0])], schema)
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "qid int, embedding array<double>")
    for search in (retrieval.knn_search, retrieval.approx_knn):
        assert [(r["qid"], r["chunk_id"], r["score"]) for r in search(corpus.limit(3), q, 5).collect()] == [(1, "a", 1.0)]
        assert search(corpus.limit(0), q, 5).count() == 0
        assert search(corpus.limit(3), q.limit(0), 5).count() == 0
    assert retrieval.knn_search(corpus, q, 5).count() == 1


def test_knn_ties_are_exact(spark):
    from quarry.operators import retrieval
    corpus = spark.createDataFrame([(f"c{i}", [1.0, 0.0]) for i in range(30)], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, embedding array<double>")
    rows = retrieval.knn_search(corpus, q, 5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["c0", "c1", "c10", "c11", "c12"]


def test_global_index_matches_order(spark):
    from quarry.operators.relational import with_global_index
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    rows = with_global_index(df, ["k"], "i").collect()
    assert all(r["k"] == r["i"] for r in rows)


def test_unknown_declarations_do_not_end_a_page():
    for mark in ("<![foo bar]>", "<![foo>", "<![>", "<![ >", "<![1]>", "<![endif]-->", "<![CDATA[x]]>", "<!foo>", "<!>", "</ x>"):
        assert [H.text_of(n) for n in H.iter_nodes(H.parse(f"<p>a</p>{mark}<p>b</p>")) if n.tag == "p"] == ["a", "b"], mark
        page = f"<h1>t</h1><p>a <a href='/x'>x</a></p>{mark}<section><p>b</p></section><a href='/y'>y</a>"
        assert [n.attrs["href"] for n in H.iter_nodes(H.parse(page)) if n.tag == "a"] == ["/x", "/y"], mark
        assert H.html_to_markdown(page).startswith("# t\n\na [x](/x)") and "\n\nb\n\n[y](/y)" in H.html_to_markdown(page), mark
        assert "<p>b</p>" in H.strip_noise(page), mark
    assert H.text_of(H.parse("<p>a<![foo")) == "a<![foo"
    long = "0" * 5000
    assert H.text_of(H.parse(f"<p>a&#{long}98;</p><p>c&#9{long};</p><p>d</p>")) == "abc\ufffdd"
