"""Registered scalar-function queries (rows 67-74, 79-86 of the inventory)."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators.counting import with_token_count
from quarry.plans.registry import register
from quarry.plans.sql_fragments import tokens_sql
from quarry.sources.decisions import DECISIONS_SQL, decisions_from_documents
from quarry.sources.tables import table

# Python whitespace as an RE2 class body (oracle side of functions.text.PY_WS).
WS = r"\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS_NO_NL = r" \t\x0B\f\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


@register("clean_markdown", sql=f"""
WITH s AS (SELECT doc_id, regexp_replace(text, '\\n', ' ' || chr(10) || chr(10) || chr(10), 'g') AS t FROM documents),
a AS (SELECT doc_id, t, regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g') AS c FROM s),
b AS (SELECT doc_id, t, regexp_replace(c, '[{WS_NO_NL}]+(\\n|$)', '\\1', 'g') AS c FROM a)
SELECT doc_id, CASE WHEN t IS NULL OR t = '' THEN '' ELSE {strip_sql('c')} || chr(10) END AS cleaned FROM b
""")
def q_clean_markdown(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    noisy = F.regexp_replace("text", "\n", " \n\n\n")
    return d.select("doc_id", T.clean_markdown(noisy).alias("cleaned"))


@register("split_paragraphs", sql=f"""
WITH p AS (
  SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)),
                                            lambda x: {strip_sql('x')}), lambda x: x <> '') AS ps
  FROM documents)
SELECT doc_id, unnest(generate_series(0, len(ps) - 1)) AS para_index, unnest(ps) AS paragraph FROM p
""")
def q_split_paragraphs(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    paras = T.split_paragraphs(F.regexp_replace("text", "\n", "\n\n"))
    return d.select("doc_id", F.posexplode(paras).alias("para_index", "paragraph")) \
        .select("doc_id", F.col("para_index").cast("long").alias("para_index"), "paragraph")


@register("split_sentences", sql=f"""
WITH s AS (
  SELECT doc_id, text, list_filter(list_transform(
           regexp_extract_all(text, '(?s)(?:[^.!?]|[.!?]+[^.!?\\s])*(?:[.!?]+(?:[ \\n\\t]|$)|$)'),
           lambda x: {strip_sql('x')}), lambda x: x <> '') AS ss
  FROM documents),
t AS (SELECT doc_id, CASE WHEN len(ss) > 0 THEN ss ELSE [text] END AS ss FROM s)
SELECT doc_id, unnest(generate_series(0, len(ss) - 1)) AS sentence_index, unnest(ss) AS sentence FROM t
""")
def q_split_sentences(spark, sf):
    d = table(spark, sf, "documents", spread=True)
    return d.select("doc_id", F.posexplode(T.split_sentences("text")).alias("sentence_index", "sentence")) \
        .select("doc_id", F.col("sentence_index").cast("long").alias("sentence_index"), "sentence")


@register("token_count", sql=f"""
SELECT doc_id, CAST(len({tokens_sql('text')}) AS BIGINT) AS token_count FROM documents
""")
def q_token_count(spark, sf):
    return table(spark, sf, "documents", spread=True).select("doc_id", T.token_count("text").alias("token_count"))


@register("token_count_pattern", sql="""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9\\x00-\\x20]')) AS BIGINT) AS token_count FROM documents
""")
def q_token_count_pattern(spark, sf):
    """Words and single marks, by a pattern as the counter."""
    docs = table(spark, sf, "documents", spread=True)
    return with_token_count(docs, "text", re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]")).select("doc_id", "token_count")


@register("token_usage_estimate", sql=f"""
SELECT source, CAST(count(*) AS BIGINT) AS n_texts,
       CAST(sum(floor(len({tokens_sql('text')}) * 1.3::DOUBLE)) AS BIGINT) AS tokens_used,
       round(sum(len({tokens_sql('text')}) * 1.3::DOUBLE), 6) AS tokens_estimate
FROM documents GROUP BY source
""")
def q_token_usage_estimate(spark, sf):
    d = table(spark, sf, "documents", spread=True).select("source", T.token_usage_estimate("text").alias("est"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"),
                                   F.sum(F.floor("est")).cast("long").alias("tokens_used"),
                                   F.round(F.sum("est"), 6).alias("tokens_estimate"))


HEADER_INPUT_SQL = """
h AS (
  SELECT doc_id, NativeId, Title, ClassificationTitle, ClassificationCode, OrganizationName, DateDecision,
         CaseID, Section, doc_id % 7 = 0 AS is_att,
         CASE WHEN doc_id % 2 = 0 THEN 'Liite ' || CAST(doc_id % 3 AS VARCHAR) END AS att_title,
         CASE WHEN doc_id % 3 = 0 THEN 'https://example.com/' || CAST(doc_id AS VARCHAR) || '.pdf' END AS att_url,
         'DOC-' || CAST(doc_id // 10 AS VARCHAR) AS parent_id
  FROM decisions)
"""


@register("metadata_header", sql=f"""
WITH {DECISIONS_SQL}, {HEADER_INPUT_SQL}
SELECT doc_id, concat_ws(chr(10), '--- Dokumentin konteksti ---',
  CASE WHEN coalesce(Title, '') <> '' AND coalesce(NativeId, '') <> '' THEN 'Päätös: "' || Title || '" (ID: ' || NativeId || ')'
       WHEN coalesce(Title, '') <> '' THEN 'Päätös: "' || Title || '"'
       WHEN coalesce(NativeId, '') <> '' THEN 'Päätös ID: ' || NativeId END,
  CASE WHEN is_att THEN
       CASE WHEN coalesce(att_title, '') <> '' AND coalesce(att_url, '') <> '' THEN 'Liite: "' || att_title || '" (' || att_url || ')'
            WHEN coalesce(att_title, '') <> '' THEN 'Liite: "' || att_title || '"'
            WHEN coalesce(att_url, '') <> '' THEN 'Liite: ' || att_url END END,
  CASE WHEN is_att AND coalesce(parent_id, '') <> '' AND parent_id IS DISTINCT FROM NativeId THEN 'Päätöksen ID: ' || parent_id END,
  CASE WHEN coalesce(ClassificationTitle, '') <> '' AND coalesce(ClassificationCode, '') <> ''
            THEN 'Luokitus: ' || ClassificationTitle || ' (' || ClassificationCode || ')'
       WHEN coalesce(ClassificationTitle, '') <> '' THEN 'Luokitus: ' || ClassificationTitle END,
  CASE WHEN coalesce(OrganizationName, '') <> '' THEN 'Organisaatio: ' || OrganizationName END,
  CASE WHEN coalesce(DateDecision, '') <> '' THEN 'Päivämäärä: ' || split_part(DateDecision, 'T', 1) END,
  CASE WHEN coalesce(CaseID, '') <> '' THEN 'Diaarinumero: ' || CaseID END,
  CASE WHEN coalesce(Section, '') <> '' THEN 'Pykälä: ' || Section END,
  '---') AS header
FROM h
""")
def q_metadata_header(spark, sf):
    d = decisions_from_documents(table(spark, sf, "documents", spread=True))
    d = d.select("*", (F.col("doc_id") % 7 == 0).alias("is_att"),
                 F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Liite "), (F.col("doc_id") % 3).cast("string")))
                 .alias("att_title"),
                 F.when(F.col("doc_id") % 3 == 0,
                        F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string"), F.lit(".pdf")))
                 .alias("att_url"),
                 F.concat(F.lit("DOC-"), F.floor(F.col("doc_id") / 10).cast("string")).alias("parent_id"))
    return d.select("doc_id", T.metadata_header(
        "Title", "NativeId", "ClassificationTitle", "ClassificationCode", "OrganizationName", "DateDecision",
        "CaseID", "Section", "is_att", "att_title", "att_url", "parent_id").alias("header"))


# Literal chat turns with identity numbers and phone numbers (ASCII neighbours
# only, so that ASCII and Unicode word boundaries agree).
PII_LITERALS = [
    ("user", "Hetu 010190-123A on tassa"), ("user", "syntynyt 010190+ ja 010190abc"),
    ("user", "pelkka 010190 numero"), ("user", "lyhyt 010190-12 loppu"),
    ("user", "numero 0101901234 ja 3502411666"), ("user", "ei 410190-123A eika 019990-123A"),
    ("user", "soita 040 123 4567 tai 09 310 13700"), ("user", "+358401234567 ja (09) 12345"),
    ("assistant", "assistentti 010190-123A ei muutu"),
]


def _pii_literal_sql() -> str:
    vals = ", ".join(f"(-1, {i}, '{r}', '{t}')" for i, (r, t) in enumerate(PII_LITERALS))
    return f"SELECT * FROM (VALUES {vals}) AS v(conv_id, turn, role, text)"


def _redact_sql(x: str, patterns, token) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', '{token}', 'g')"
    return x


@register("redact_pii", sql=f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL {_pii_literal_sql()})
SELECT conv_id, turn, role,
  CASE WHEN role = 'user' THEN {_redact_sql('text', T.HETU_PATTERNS, T.HETU_TOKEN)} ELSE text END AS text_redacted,
  CASE WHEN role = 'user' THEN {_redact_sql(_redact_sql('text', T.HETU_PATTERNS, T.HETU_TOKEN), T.PHONE_PATTERNS, T.PHONE_TOKEN)}
       ELSE text END AS text_redacted_phone
FROM c
""")
def q_redact_pii(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    lit = spark.createDataFrame([(-1, i, r, t) for i, (r, t) in enumerate(PII_LITERALS)],
                                "conv_id long, turn long, role string, text string")
    c = conv.unionByName(lit)
    user = F.col("role") == "user"
    return c.select("conv_id", "turn", "role",
                    F.when(user, T.redact_pii("text", "hetu")).otherwise(F.col("text")).alias("text_redacted"),
                    F.when(user, T.redact_pii("text", "hetu_phone")).otherwise(F.col("text"))
                    .alias("text_redacted_phone"))


SECRET_LITERALS = ["api_key=abc123 and more", "Token: xyz-789 here", "PASSWORD=hunter2",
                   "secret:  s3-cr3t ok", "apikey=foo;bar", "plain text without secrets"]


@register("redact_secrets", sql=f"""
WITH t AS (SELECT doc_id, text FROM documents
           UNION ALL SELECT * FROM (VALUES {", ".join(f"({-1 - i}, '{s}')" for i, s in enumerate(SECRET_LITERALS))}) v(doc_id, text))
SELECT doc_id, regexp_replace(text, '{T.SECRET_PATTERN}', '\\1=REDACTED', 'g') AS text_redacted FROM t
""")
def q_redact_secrets(spark, sf):
    d = table(spark, sf, "documents", spread=True).select("doc_id", "text")
    lit = spark.createDataFrame([(-1 - i, s) for i, s in enumerate(SECRET_LITERALS)], "doc_id long, text string")
    return d.unionByName(lit).select("doc_id", T.redact_secrets("text").alias("text_redacted"))


@register("camel_space", sql="""
SELECT doc_id, CASE WHEN regexp_matches(text, '^[A-Z]') THEN substr(regexp_replace(text, '([A-Z])', ' \\1', 'g'), 2)
                    ELSE regexp_replace(text, '([A-Z])', ' \\1', 'g') END AS spaced
FROM documents
""")
def q_camel_space(spark, sf):
    return table(spark, sf, "documents", spread=True).select("doc_id", T.camel_space("text").alias("spaced"))


@register("normalize_url", sql="""
SELECT page_id, url, regexp_replace(url, '^([^?#]*)\\?[^#]*', '\\1') AS url_normalized FROM pages
""")
def q_normalize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", T.normalize_url("url").alias("url_normalized"))


URI_LITERALS = ["https://example.com/file.pdf", "https://example.com/file.docx",
                "https://example.com/file.PDF?param=value", "https://example.com/file",
                "https://example.com/.hidden", "https://example.com/archive.tar.gz", "https://example.com/trail."]


@register("uri_extension", sql=f"""
WITH u AS (SELECT page_id, url FROM pages
           UNION ALL SELECT * FROM (VALUES {", ".join(f"({-1 - i}, '{u}')" for i, u in enumerate(URI_LITERALS))}) v(page_id, url)),
e AS (SELECT page_id, url, regexp_extract(regexp_extract(regexp_extract(url, '^([^?]*)', 1), '([^/]*)$', 1),
                                          '^.+?(\\.[^.]+)$', 1) AS ext FROM u)
SELECT page_id, url, CASE WHEN ext = '' THEN '.bin' ELSE lower(ext) END AS extension FROM e
""")
def q_uri_extension(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    lit = spark.createDataFrame([(-1 - i, u) for i, u in enumerate(URI_LITERALS)], "page_id long, url string")
    return p.unionByName(lit).select("page_id", "url", T.uri_extension("url").alias("extension"))


@register("safe_name", sql="""
SELECT page_id, translate(url, '/\\:', '___') AS safe_url,
       replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ' ', '_') AS entry_name
FROM pages
""")
def q_safe_name(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", T.safe_name("url").alias("safe_url"),
                    F.replace(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit(" "), F.lit("_"))
                    .alias("entry_name"))


@register("parse_dates", sql="""
WITH s AS (
  SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                                        WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y %H:%M')
                                        ELSE strftime(o_orderdate, '%Y/%m/%d') END AS raw
  FROM orders)
SELECT o_orderkey, raw,
       strftime(coalesce(try_strptime(raw, '%Y-%m-%d %H:%M:%S'), try_strptime(raw, '%d.%m.%Y %H:%M'),
                         try_strptime(raw, '%Y/%m/%d')), '%Y-%m-%dT%H:%M:%S') AS iso
FROM s
""")
def q_parse_dates(spark, sf):
    o = table(spark, sf, "orders")
    raw = (F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
           .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy HH:mm"))
           .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd")))
    s = o.select("o_orderkey", raw.alias("raw"))
    return s.select("o_orderkey", "raw",
                    D.iso_text(D.parse_lenient("raw", D.DEFAULT_FORMATS)).alias("iso"))


@register("date_batches", sql="""
WITH r AS (SELECT o_orderpriority, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority, s, e, unnest(generate_series(s, e, INTERVAL 7 DAY)) AS bs FROM r)
SELECT o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY bs) - 1 AS BIGINT) AS batch_index,
       bs AS batch_start, least(bs + INTERVAL 7 DAY, e) AS batch_end,
       CAST((floor((epoch(e) - epoch(s)) / 86400) + 6) // 7 AS BIGINT) AS weeks
FROM b WHERE bs < e
""")
def q_date_batches(spark, sf):
    o = table(spark, sf, "orders")
    r = o.groupBy("o_orderpriority").agg(F.min("o_orderdate").alias("s"), F.max("o_orderdate").alias("e"))
    return D.date_batches(r, "s", "e", step_days=7, keep=("o_orderpriority",)) \
        .select("o_orderpriority", "batch_index", "batch_start", "batch_end", "weeks")


@register("vector_literal", sql="""
SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, embedding AS vector FROM embeddings
""")
def q_vector_literal(spark, sf):
    e = table(spark, sf, "embeddings")
    txt = e.select("vec_id", V.format_vector("embedding").alias("literal"))
    return txt.select("vec_id", F.size(V.parse_vector("literal")).cast("long").alias("dims"),
                      V.parse_vector("literal").alias("vector"))


@register("cosine_similarity", sql="""
SELECT a.vec_id, b.vec_id AS next_id,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def q_cosine_similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    a, b = e.alias("a"), e.alias("b")
    j = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    return j.select(F.col("a.vec_id").alias("vec_id"), F.col("b.vec_id").alias("next_id"),
                    F.round(V.cosine("a.embedding", "b.embedding"), 6).alias("cosine"))
