"""Registered relational queries: projections, filters, joins, aggregations,
windows, ordering and set operations (rows 19-59, 63-66 of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import dates as D
from quarry.functions import text as T
from quarry.operators import quality as Q
from quarry.operators import relational as R
from quarry.plans.registry import register
from quarry.plans.sql_fragments import CHUNK_TOKENS_CTE, tokens_sql
from quarry.sources.decisions import DECISIONS_SQL, decisions_from_documents
from quarry.sources.tables import table


def _decisions(spark, sf):
    return decisions_from_documents(table(spark, sf, "documents"))


# ------------------------------------------------------------------ projections
@register("document_metadata", sql=f"""
WITH {DECISIONS_SQL}
SELECT doc_id, 'decisions' AS collection_name,
       CASE WHEN coalesce(Title, '') <> '' THEN Title || '.md' ELSE 'Unknown Source' END AS source,
       CASE WHEN coalesce(Title, '') <> '' THEN Title || '.md' ELSE 'Unknown Source' END AS name,
       coalesce(NativeId, '') AS file_id, coalesce(NativeId, '') AS native_id, coalesce(Title, '') AS title,
       coalesce(CaseID, '') AS case_id, coalesce(Section, '') AS section,
       coalesce(ClassificationCode, '') AS classification_code, coalesce(ClassificationTitle, '') AS classification_title,
       CASE WHEN coalesce(DateDecision, '') <> '' THEN DateDecision END AS date_decision,
       coalesce(OrganizationName, '') AS organization_name, false AS is_attachment
FROM decisions
""")
def q_document_metadata(spark, sf):
    return R.document_metadata(_decisions(spark, sf))


def _order_decisions(spark, sf):
    """orders as decisions, lineitems as their attachments (array column)."""
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    att = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.struct(F.col("l_linenumber").alias("AttachmentNumber"),
                 F.concat(F.lit("Liite "), F.col("l_linenumber").cast("string")).alias("Title"),
                 F.col("l_returnflag").alias("Type"),
                 F.when(F.col("l_linenumber") % 5 != 0,
                        F.concat(F.lit("https://example.com/"), F.col("l_orderkey").cast("string"), F.lit("/"),
                                 F.col("l_linenumber").cast("string"), F.lit(".pdf"))).alias("FileURI"),
                 F.when(F.col("l_returnflag") == "R", F.lit("Salainen"))
                 .when(F.col("l_returnflag") == "A", F.lit("Julkinen")).alias("PublicityClass"),
                 F.when(F.col("l_linestatus") == "F", F.lit("Sisältää henkilötietoja"))
                 .otherwise(F.lit("Ei sisällä henkilötietoja")).alias("PersonalData"),
                 F.when(F.col("l_linenumber") % 3 != 0,
                        F.concat(F.lit("ATT-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                                 F.col("l_linenumber").cast("string"))).alias("NativeId")).alias("a"))
    att = att.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "a").alias("k"))
    arr = att.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("k")), lambda x: x["a"])
                                        .alias("Attachments"))
    dec = o.select(F.col("o_orderkey"), F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("NativeId"),
                   F.col("o_orderpriority").alias("Title"),
                   F.date_format("o_orderdate", "yyyy-MM-dd").alias("DateDecision"),
                   F.col("o_orderstatus").alias("OrganizationName"))
    return dec.join(arr, dec["o_orderkey"] == arr["l_orderkey"], "left").drop("l_orderkey")


ATTACHMENTS_SQL = """
atts AS (
  SELECT l_orderkey AS o_orderkey, 'ORD-' || CAST(l_orderkey AS VARCHAR) AS decision_native_id, l_linenumber AS AttachmentNumber,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS position,
         'Liite ' || CAST(l_linenumber AS VARCHAR) AS Title, l_returnflag AS Type,
         CASE WHEN l_linenumber % 5 <> 0 THEN 'https://example.com/' || CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '.pdf' END AS FileURI,
         CASE WHEN l_returnflag = 'R' THEN 'Salainen' WHEN l_returnflag = 'A' THEN 'Julkinen' END AS PublicityClass,
         CASE WHEN l_linestatus = 'F' THEN 'Sisältää henkilötietoja' ELSE 'Ei sisällä henkilötietoja' END AS PersonalData,
         CASE WHEN l_linenumber % 3 <> 0 THEN 'ATT-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS NativeId
  FROM lineitem)
"""


@register("explode_attachments", sql=f"""
WITH {ATTACHMENTS_SQL}
SELECT decision_native_id, position,
       coalesce(nullif(NativeId, ''), 'att_' || CAST(coalesce(nullif(AttachmentNumber, 0), position + 1) AS VARCHAR)) AS attachment_native_id,
       CAST(AttachmentNumber AS BIGINT) AS attachment_number
FROM atts
WHERE coalesce(FileURI, '') <> '' AND (coalesce(PublicityClass, '') = '' OR PublicityClass = 'Julkinen')
  AND (coalesce(PersonalData, '') = '' OR PersonalData = 'Ei sisällä henkilötietoja')
""")
def q_explode_attachments(spark, sf):
    ex = R.explode_attachments(_order_decisions(spark, sf))
    ok = Q.attachment_ok("FileURI", "PublicityClass", "PersonalData")
    return ex.where(ok).select("decision_native_id", "position", "attachment_native_id",
                               F.col("AttachmentNumber").cast("long").alias("attachment_number"))


@register("attachment_gate", sql=f"""
WITH {ATTACHMENTS_SQL}
SELECT decision_native_id, CAST(AttachmentNumber AS BIGINT) AS attachment_number,
       coalesce(FileURI, '') <> '' AND (coalesce(PublicityClass, '') = '' OR PublicityClass = 'Julkinen')
       AND (coalesce(PersonalData, '') = '' OR PersonalData = 'Ei sisällä henkilötietoja') AS fetch_ok
FROM atts
""")
def q_attachment_gate(spark, sf):
    ex = R.explode_attachments(_order_decisions(spark, sf))
    return ex.select("decision_native_id", F.col("AttachmentNumber").cast("long").alias("attachment_number"),
                     Q.attachment_ok("FileURI", "PublicityClass", "PersonalData").alias("fetch_ok"))


@register("attachment_metadata", sql=f"""
WITH {ATTACHMENTS_SQL},
parent AS (SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS native_id, o_orderpriority AS title, o_orderstatus AS organization_name,
                  strftime(o_orderdate, '%Y-%m-%d') AS date_decision FROM orders)
SELECT a.decision_native_id, p.native_id, p.native_id AS file_id, p.title, 'decisions' AS collection_name, p.title || '.md' AS source,
       p.title || '.md' AS name, '' AS case_id, '' AS section, '' AS classification_code, '' AS classification_title,
       p.date_decision, p.organization_name, true AS is_attachment,
       coalesce(nullif(a.NativeId, ''), 'att_' || CAST(coalesce(nullif(a.AttachmentNumber, 0), position + 1) AS VARCHAR)) AS attachment_native_id,
       coalesce(a.Title, '') AS attachment_title, CAST(coalesce(a.AttachmentNumber, 0) AS BIGINT) AS attachment_number,
       coalesce(a.Type, '') AS attachment_type, coalesce(a.FileURI, '') AS attachment_url
FROM atts a JOIN parent p ON a.decision_native_id = p.native_id
""")
def q_attachment_metadata(spark, sf):
    none = F.lit(None).cast("string")
    return R.attachment_metadata(_order_decisions(spark, sf).withColumns(
        {"CaseID": none, "Section": none, "ClassificationCode": none, "ClassificationTitle": none}))


@register("metadata_only", sql=f"""
WITH {DECISIONS_SQL}
SELECT doc_id, NativeId, Title, ClassificationCode, ClassificationTitle, OrganizationName, DateDecision, CaseID FROM decisions
""")
def q_metadata_only(spark, sf):
    return _decisions(spark, sf).drop("Content", "Section")


@register("document_summary", sql=f"""
WITH {DECISIONS_SQL}
SELECT NativeId AS native_id, CASE WHEN coalesce(Title, '') <> '' THEN Title ELSE 'Untitled' END AS title,
       DateDecision AS date_decision, OrganizationName AS organization, ClassificationTitle AS classification
FROM decisions
""")
def q_document_summary(spark, sf):
    d = _decisions(spark, sf)
    return d.select(F.col("NativeId").alias("native_id"),
                    F.when(F.coalesce(F.col("Title"), F.lit("")) != "", F.col("Title")).otherwise(F.lit("Untitled"))
                    .alias("title"),
                    F.col("DateDecision").alias("date_decision"), F.col("OrganizationName").alias("organization"),
                    F.col("ClassificationTitle").alias("classification"))


@register("document_detail", sql=f"""
WITH {ATTACHMENTS_SQL},
a AS (SELECT decision_native_id, count(*) AS attachments, count(*) FILTER (WHERE PublicityClass IS NULL) AS unclassed,
             string_agg(coalesce(NativeId, '-') || '|' || Title || '|' || coalesce(FileURI, '-') || '|' || Type, ';' ORDER BY position) AS listed
      FROM atts GROUP BY 1)
SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS native_id, coalesce(nullif(o_orderpriority, ''), 'Untitled') AS title,
       strftime(o_orderdate, '%Y-%m-%d') AS decision_date, o_orderstatus AS organization_name,
       coalesce(attachments, 0) AS attachments, coalesce(unclassed, 0) AS unclassed, listed
FROM orders LEFT JOIN a ON decision_native_id = 'ORD-' || CAST(o_orderkey AS VARCHAR)
""")
def q_document_detail(spark, sf):
    """The detail views; their attachment arrays as texts, for comparing."""
    d = R.document_detail(_order_decisions(spark, sf))
    att = F.col("attachments")
    listed = F.array_join(F.transform(att, lambda a: F.concat_ws(
        "|", F.coalesce(a["native_id"], F.lit("-")), a["title"], F.coalesce(a["file_uri"], F.lit("-")), a["type"])), ";")
    return d.select("native_id", "title", "decision_date", F.col("organization.name").alias("organization_name"),
                    F.coalesce(F.size(F.coalesce(att, F.array().cast(d.schema["attachments"].dataType))), F.lit(0)).cast("long").alias("attachments"),
                    F.coalesce(F.size(F.filter(att, lambda a: a["publicity_class"].isNull())), F.lit(0)).cast("long").alias("unclassed"),
                    listed.alias("listed"))


@register("chunk_index_metadata", sql=f"""
WITH {DECISIONS_SQL}, {CHUNK_TOKENS_CTE.strip()}
SELECT OrganizationName AS collection, doc_id || '_chunk_' || idx AS id, array_to_string(ctok, ' ') AS text,
       CAST(len(ctok) AS BIGINT) AS token_count, CAST(idx AS BIGINT) AS chunk_index, coalesce(NativeId, '') AS native_id,
       coalesce(CaseID, '') AS case_id, coalesce(Section, '') AS section
FROM w JOIN decisions USING (doc_id)
""")
def q_chunk_index_metadata(spark, sf):
    """Stored rows of all document chunks, their metadata struct laid out."""
    from quarry.operators.chunking import fixed_token_chunks
    d = _decisions(spark, sf).where(F.coalesce(F.col("Content"), F.lit("")) != "").withColumn("native_id", F.col("NativeId"))
    chunks = fixed_token_chunks(d, "Content", "doc_id", keep=("native_id", "CaseID", "Section", "OrganizationName"))
    rows = R.chunk_index_rows(chunks.withColumn("embedding", F.lit(None).cast("array<double>")), F.col("OrganizationName"),
                              ["CaseID", "Section"])
    m = F.col("metadata")
    return rows.select("collection", "id", "text", m["token_count"].alias("token_count"),
                       m["chunk_index"].cast("long").alias("chunk_index"), m["native_id"].alias("native_id"),
                       m["CaseID"].alias("case_id"), m["Section"].alias("section"))


@register("chunk_index_rows", sql="""
SELECT 'label_' || CAST(label AS VARCHAR) AS collection, 'vec-' || CAST(vec_id AS VARCHAR) AS id,
       embedding AS vector, 'DOC-' || CAST(vec_id // 10 AS VARCHAR) AS native_id, CAST(vec_id % 10 AS BIGINT) AS chunk_index,
       CAST(len(embedding) AS BIGINT) AS dims
FROM embeddings
""")
def q_chunk_index_rows(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("collection"),
                    F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("id"),
                    F.col("embedding").alias("vector"),
                    F.concat(F.lit("DOC-"), F.floor(F.col("vec_id") / 10).cast("string")).alias("native_id"),
                    (F.col("vec_id") % 10).cast("long").alias("chunk_index"),
                    F.size("embedding").cast("long").alias("dims"),
                    F.current_timestamp().alias("indexed_at")).drop("indexed_at")


# ------------------------------------------------------------------ filters
ID_LITERALS = ["TEST-2024-001", "", "   ", None, "x" * 199, "y" * 200, "HEL:2024-001"]


@register("valid_native_id", sql=f"""
WITH ids AS (SELECT c_name AS id FROM customer
             UNION ALL SELECT * FROM (VALUES {", ".join("(NULL)" if v is None else f"('{v}')" for v in ID_LITERALS)}) v(id))
SELECT id, coalesce(id IS NOT NULL AND length(regexp_replace(id, '^\\s+|\\s+$', '', 'g')) > 0 AND length(id) < 200, false) AS is_valid
FROM ids
""")
def q_valid_native_id(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("id"))
    lit = spark.createDataFrame([(v,) for v in ID_LITERALS], "id string")
    return c.unionByName(lit).select("id", Q.valid_native_id("id").alias("is_valid"))


# Listed by hand: what Python's date parsing accepts and rejects.
GOOD_DATES = ["2024-01-15", "2024-01-15T10:00:00.000", "2024-01-15T10:00:00Z", "20240115", "2024-1-5",
              "2024-01-15T10", "2024-01-15 10:30", "2024-01-15T1030", "20240115T103000",
              "2024-01-15T10:30:00+02:00", "2024-01-15T10:30:00+0200", "2024-01-15T10:30:00,123456"]
BAD_DATES = ["2024-02-30", "2024", "2024-01", " 2024-01-15", "not a date", "2024-13-01", "2024-01-15T25:00",
             "2024-0115", "202401-15", "2024-01-15T10:0000", "2024-01-15T10:30:60", "2024-01-15T1030:00"]

#: (NativeId, Title, DateDecision, expected error) of rows added to the documents.
VALIDATION_CASES = ([(f"GOOD-{i}", "title", d, None) for i, d in enumerate(GOOD_DATES)]
                    + [(f"BAD-{i}", "title", d, f"Invalid DateDecision format: {d}") for i, d in enumerate(BAD_DATES)]
                    + [("  ", "t", None, "Invalid NativeId:   "),
                       ("NO-CONTENT", "", None, "Document NO-CONTENT has no Title or Content")])


def _quoted(v):
    return "NULL" if v is None else f"'{v}'"


_CASES_SQL = ", ".join(f"({-1 - i}, {_quoted(e)})" for i, (_, _, _, e) in enumerate(VALIDATION_CASES))
#: The mapping gives every document a valid id and date: only empty ones fail.
VALIDATED_SQL = f"""
v AS (SELECT doc_id, CASE WHEN coalesce(Title, '') = '' AND coalesce(Content, '') = ''
                          THEN 'Document ' || NativeId || ' has no Title or Content' END AS error,
             coalesce(Content, '') = '' AS empty FROM decisions
      UNION ALL SELECT *, true FROM (VALUES {_CASES_SQL}) c(doc_id, error))
"""


def _validated(spark, sf):
    d = _decisions(spark, sf).select("doc_id", "NativeId", "Title", "Content", "DateDecision")
    rows = [(-1 - i, n, t, None, day) for i, (n, t, day, _) in enumerate(VALIDATION_CASES)]
    return Q.validate_documents(d.unionByName(spark.createDataFrame(rows, d.schema)))


@register("validate_documents", sql=f"WITH {DECISIONS_SQL}, {VALIDATED_SQL} SELECT doc_id, error FROM v")
def q_validate_documents(spark, sf):
    return _validated(spark, sf).select("doc_id", "error")


NOW = "2024-06-01 00:00:00"


@register("validate_date_ranges", sql=f"""
WITH r AS (SELECT o_orderkey, o_orderdate AS s, o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER) - 1) AS e FROM orders)
SELECT o_orderkey, CASE
  WHEN s >= e THEN 'Start date ' || strftime(s, '%Y-%m-%d %H:%M:%S') || ' must be before end date ' || strftime(e, '%Y-%m-%d %H:%M:%S')
  WHEN s < TIMESTAMP '2000-01-01 00:00:00' THEN 'Start date ' || strftime(s, '%Y-%m-%d %H:%M:%S') || ' is before minimum date 2000-01-01 00:00:00'
  WHEN e > TIMESTAMP '{NOW}' THEN 'End date ' || strftime(e, '%Y-%m-%d %H:%M:%S') || ' is in the future'
  END AS error
FROM r
""")
def q_validate_date_ranges(spark, sf):
    o = table(spark, sf, "orders")
    r = o.select("o_orderkey", F.col("o_orderdate").alias("s"),
                 F.timestamp_add("DAY", (F.col("o_orderkey") % 5 - 1).cast("int"), "o_orderdate").alias("e"))
    return r.select("o_orderkey", Q.date_range_error(F.col("s").cast("timestamp"), F.col("e").cast("timestamp"),
                                                     F.lit(NOW).cast("timestamp")).alias("error"))


@register("date_window_scan", sql="""
SELECT o_orderkey, o_orderdate,
       TIMESTAMP '1996-01-01' + to_days(CAST(floor(date_diff('day', TIMESTAMP '1996-01-01', o_orderdate) / 7) * 7 AS INTEGER)) AS batch_start
FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'
""")
def q_date_window_scan(spark, sf):
    o = table(spark, sf, "orders")
    start = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    w = o.where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < F.lit("1996-07-01 00:00:00").cast("timestamp_ntz")))
    days = F.datediff(F.col("o_orderdate"), start)
    return w.select("o_orderkey", "o_orderdate",
                    F.timestamp_add("DAY", (F.floor(days / 7) * 7).cast("int"), start).alias("batch_start"))


@register("from_date_filter", sql="""
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01'
""")
def q_from_date_filter(spark, sf):
    o = table(spark, sf, "orders")
    return o.where(F.col("o_orderdate") >= F.lit("2000-06-01 00:00:00").cast("timestamp_ntz")).select("o_orderkey", "o_orderdate")


EMBARGO_NOW = "2024-02-20 08:00:00"


@register("embargo_window", sql=f"""
SELECT event_id, ts FROM events
WHERE ts BETWEEN date_trunc('day', TIMESTAMP '{EMBARGO_NOW}' - INTERVAL 39 DAY)
             AND date_trunc('day', TIMESTAMP '{EMBARGO_NOW}' - INTERVAL 38 DAY) + INTERVAL '23:59:59'
""")
def q_embargo_window(spark, sf):
    e = table(spark, sf, "events")
    lo, hi = D.embargo_bounds(F.lit(EMBARGO_NOW).cast("timestamp"))
    return e.where(F.col("ts").between(lo, hi)).select("event_id", "ts")


@register("content_gate", sql=f"""
WITH req AS (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels),
j AS (SELECT r.doc_id, d.text, l.quality FROM req r LEFT JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE
  WHEN quality = 1 THEN 'skipped'
  WHEN text IS NULL THEN 'failed: missing'
  WHEN text = '' THEN 'failed: no content'
  WHEN regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g') = '' THEN 'failed: conversion empty'
  WHEN len({tokens_sql('text')}) = 0 THEN 'failed: no chunks'
  ELSE 'success' END AS outcome
FROM j
""")
def q_content_gate(spark, sf):
    docs = table(spark, sf, "documents", spread=True).select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    req = docs.select("doc_id").union(lab.select("doc_id")).distinct()
    j = req.join(docs, "doc_id", "left").join(lab, "doc_id", "left")
    outcome = (F.when(F.col("quality") == 1, "skipped").when(F.col("text").isNull(), "failed: missing")
               .when(F.col("text") == "", "failed: no content")
               .when(T.py_strip("text") == "", "failed: conversion empty")
               .when(T.token_count("text") == 0, "failed: no chunks").otherwise("success"))
    return j.select("doc_id", outcome.alias("outcome"))


@register("embedding_gate", sql=f"""
WITH req AS (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels),
j AS (SELECT r.doc_id, d.text, l.quality, e.n FROM req r LEFT JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)
      LEFT JOIN (SELECT vec_id AS doc_id, count(embedding) AS n FROM embeddings GROUP BY 1) e USING (doc_id))
SELECT doc_id, CASE
  WHEN quality = 1 THEN 'skipped'
  WHEN text IS NULL THEN 'failed: missing'
  WHEN text = '' THEN 'failed: no content'
  WHEN regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g') = '' THEN 'failed: conversion empty'
  WHEN len({tokens_sql('text')}) = 0 THEN 'failed: no chunks'
  WHEN coalesce(n, 0) = 0 THEN 'failed: embedding'
  ELSE 'success' END AS outcome
FROM j
""")
def q_embedding_gate(spark, sf):
    """The content gate to its end.  What each document needs is computed in its
    own row first, so that only ids and flags are joined, no texts."""
    own = table(spark, sf, "documents", spread=True).select(
        "doc_id", F.when(F.length("text") > 0, F.lit("x")).when(F.col("text").isNotNull(), F.lit("")).alias("content"),
        F.when(T.py_strip("text") != "", F.lit("x")).alias("markdown"), T.token_count("text").alias("chunks"))
    known = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("known"))
    vectors = table(spark, sf, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.count("embedding").alias("embedded"))
    j = own.join(known, "doc_id", "full").join(vectors, "doc_id", "left")
    return j.select("doc_id", Q.content_outcome("known", "content", "markdown", "chunks", "embedded").alias("outcome"))


MD_LITERALS_SQL = ("SELECT * FROM (VALUES (-1, ''), (-2, '   '), (-3, '<HTML><body>x</body>'), (-4, 'ok text'), "
                   "(-5, 'soft' || chr(173) || 'hyphen'), (-6, 'zero' || chr(8203) || 'width'), "
                   "(-7, 'tab' || chr(9) || 'and' || chr(10) || 'newline ok'), (-8, 'bell' || chr(7)), "
                   "(-9, 'closing </html> tag')) v(doc_id, text)")


@register("markdown_quality_gate", sql=f"""
WITH t AS (SELECT doc_id, text FROM documents UNION ALL {MD_LITERALS_SQL})
SELECT doc_id, NOT (text IS NULL OR regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g') = '')
       AND NOT regexp_matches(lower(text), '<html|</html>')
       AND NOT regexp_matches(regexp_replace(text, '[\\s\\x0B\\x{{1C}}-\\x{{1F}}\\x{{85}}]', '', 'g'), '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}\\p{{Cs}}]') AS markdown_ok
FROM t
""")
def q_markdown_quality_gate(spark, sf):
    d = table(spark, sf, "documents", spread=True).select("doc_id", "text")
    lit = spark.createDataFrame([(-1, ""), (-2, "   "), (-3, "<HTML><body>x</body>"), (-4, "ok text"),
                                 (-5, "soft­hyphen"), (-6, "zero​width"), (-7, "tab\tand\nnewline ok"),
                                 (-8, "bell\x07"), (-9, "closing </html> tag")], "doc_id long, text string")
    return d.unionByName(lit).select("doc_id", T.markdown_ok("text").alias("markdown_ok"))


@register("metadata_filter", sql=f"""
WITH {DECISIONS_SQL}
SELECT doc_id, NativeId, DateDecision, OrganizationName FROM decisions
WHERE DateDecision IS NOT NULL AND substr(DateDecision, 1, 10) >= '2024-01-10' AND substr(DateDecision, 1, 10) <= '2024-02-10'
  AND OrganizationName = 'src3'
""")
def q_metadata_filter(spark, sf):
    from quarry.operators.search_filters import metadata_filter
    d = _decisions(spark, sf)
    return metadata_filter(d, date_col="DateDecision", date_gte="2024-01-10", date_lte="2024-02-10",
                           equals={"OrganizationName": "src3"}) \
        .select("doc_id", "NativeId", "DateDecision", "OrganizationName")


# ------------------------------------------------------------------ joins
@register("skip_existing", sql="""
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def q_skip_existing(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@register("skip_existing_counts", sql="""
SELECT CAST(count(*) FILTER (WHERE l.doc_id IS NULL) AS BIGINT) AS to_fetch,
       CAST(count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS BIGINT) AS skipped
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
""")
def q_skip_existing_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels").select("doc_id").distinct().withColumn("_hit", F.lit(1))
    j = d.join(lab, "doc_id", "left")
    return j.agg(F.count_if(F.col("_hit").isNull()).cast("long").alias("to_fetch"),
                 F.count_if(F.col("_hit").isNotNull()).cast("long").alias("skipped"))


STORE_SQL = """
store AS (
  SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS native_id, NULL AS decision_native_id FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT 'ATT-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR), 'ORD-' || CAST(l_orderkey AS VARCHAR)
  FROM lineitem WHERE l_returnflag = 'R')
"""


def _store(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("native_id"),
        F.lit(None).cast("string").alias("decision_native_id"))
    li = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.concat(F.lit("ATT-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
        .alias("native_id"), F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string")).alias("decision_native_id"))
    return o.unionByName(li)


@register("document_exists", sql=f"""
WITH {STORE_SQL}, ids AS (SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS id FROM orders)
SELECT id, EXISTS (SELECT 1 FROM store s WHERE s.native_id = ids.id) AS exists_own,
       EXISTS (SELECT 1 FROM store s WHERE s.native_id = ids.id OR s.decision_native_id = ids.id) AS exists_own_or_parent
FROM ids
""")
def q_document_exists(spark, sf):
    ids = table(spark, sf, "orders").select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("id"))
    return R.document_exists(ids, _store(spark, sf), "id")


@register("attach_embeddings", sql=f"""
WITH ch AS (SELECT doc_id, CAST(doc_id AS VARCHAR) || '_chunk_0' AS chunk_id, len({tokens_sql('text')}) AS tokens FROM documents)
SELECT ch.chunk_id, CAST(ch.tokens AS BIGINT) AS token_count, CAST(len(e.embedding) AS BIGINT) AS dims, e.label
FROM ch JOIN embeddings e ON ch.chunk_id = CAST(e.vec_id AS VARCHAR) || '_chunk_0'
""")
def q_attach_embeddings(spark, sf):
    ch = table(spark, sf, "documents").select(T.chunk_id("doc_id", F.lit(0)).alias("chunk_id"),
                                              T.token_count("text").alias("token_count"))
    e = table(spark, sf, "embeddings").select(T.chunk_id("vec_id", F.lit(0)).alias("chunk_id"),
                                              F.size("embedding").cast("long").alias("dims"), "label")
    return ch.join(e, "chunk_id")


@register("failed_ids", sql="""
SELECT doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.n_chars >= 1000)
""")
def q_failed_ids(spark, sf):
    loaded = table(spark, sf, "documents").where(F.col("n_chars") >= 1000).select("doc_id")
    return table(spark, sf, "labels").select("doc_id").join(loaded, "doc_id", "left_anti")


# ------------------------------------------------------------------ aggregations
@register("repository_stats", sql=f"""
WITH {DECISIONS_SQL}
SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(strlen(Content)) AS BIGINT) AS total_bytes,
       round(sum(strlen(Content)) / 1048576.0, 2) AS total_mb,
       min(DateDecision) AS first_date, max(DateDecision) AS last_date
FROM decisions
""")
def q_repository_stats(spark, sf):
    d = _decisions(spark, sf)
    return d.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("Content")).cast("long").alias("total_bytes"),
                 F.round(F.sum(F.octet_length("Content")) / 1048576.0, 2).alias("total_mb"),
                 F.min("DateDecision").alias("first_date"), F.max("DateDecision").alias("last_date"))


@register("store_stats", sql=f"""
WITH {DECISIONS_SQL}, {STORE_SQL}
SELECT CAST(count(*) AS BIGINT) AS chunks, CAST(count(DISTINCT coalesce(decision_native_id, native_id)) AS BIGINT) AS documents,
       CAST(sum(strlen(native_id)) AS BIGINT) AS id_bytes
FROM store
""")
def q_store_stats(spark, sf):
    s = _store(spark, sf)
    return s.agg(F.count(F.lit(1)).alias("chunks"),
                 F.countDistinct(F.coalesce("decision_native_id", "native_id")).alias("documents"),
                 F.sum(F.octet_length("native_id")).cast("long").alias("id_bytes"))


@register("chunk_stats", sql=f"""
WITH d AS (SELECT doc_id, text, {tokens_sql('text')} AS tok FROM documents WHERE text IS NOT NULL AND text <> ''),
w AS (SELECT doc_id, len(list_slice(tok, s + 1, s + 400)) AS n
      FROM (SELECT doc_id, tok, unnest(generate_series(0, CAST(ceil(greatest(len(tok) - 400, 0) / 350.0) * 350 AS BIGINT), 350)) AS s
            FROM d WHERE len(tok) > 0)),
p AS (SELECT doc_id, len(list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)),
                                     lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')) AS paragraphs FROM d)
SELECT w.doc_id, CAST(p.paragraphs AS BIGINT) AS paragraphs, CAST(count(*) AS BIGINT) AS chunks,
       round(avg(n), 6) AS avg_tokens, CAST(min(n) AS BIGINT) AS min_tokens, CAST(max(n) AS BIGINT) AS max_tokens
FROM w JOIN p USING (doc_id) GROUP BY w.doc_id, p.paragraphs
""")
def q_chunk_stats(spark, sf):
    from quarry.operators.chunking import fixed_token_chunks
    d = table(spark, sf, "documents", spread=True).where(F.col("text").isNotNull() & (F.col("text") != "")) \
        .select("doc_id", "text", F.size(T.split_paragraphs(F.regexp_replace("text", "\n", "\n\n"))).cast("long")
                .alias("paragraphs"))
    ch = fixed_token_chunks(d, "text", "doc_id", 400, 50, keep=("paragraphs",))
    return ch.groupBy("doc_id", "paragraphs").agg(
        F.count(F.lit(1)).alias("chunks"), F.round(F.avg("token_count"), 6).alias("avg_tokens"),
        F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"))


@register("ingest_batch_stats", sql="""
SELECT CAST(ts AS DATE) AS batch_date, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE event_type <> 'view') AS BIGINT) AS processed,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS successful,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed,
       CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS skipped,
       CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type = 'purchase'), 0) AS BIGINT) AS chunks,
       CAST(count(*) FILTER (WHERE event_type = 'signup') AS BIGINT) AS attachments,
       CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type = 'signup'), 0) AS BIGINT) AS attachment_chunks
FROM events GROUP BY 1
""")
def q_ingest_batch_stats(spark, sf):
    from quarry.operators.ledger import ingest_batch_stats
    e = table(spark, sf, "events")
    kind, n = F.col("event_type"), F.floor("value").cast("long")
    outcome = F.when(kind == "purchase", "successful").when(kind == "error", "failed").when(kind == "view", "skipped")
    return ingest_batch_stats(e.select(
        F.to_date("ts").alias("batch_date"), outcome.alias("outcome"), n.alias("chunks"),
        F.when(kind == "signup", 1).alias("attachments"), F.when(kind == "signup", n).alias("attachment_chunks")),
        "batch_date")


@register("error_digest", sql="""
WITH e AS (SELECT CAST(ts AS DATE) AS batch_date, event_id, props,
                  row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS rn
           FROM events WHERE event_type = 'error')
SELECT batch_date, CAST(count(*) AS BIGINT) AS failed,
       list(CAST(event_id AS VARCHAR) || ':' || props ORDER BY event_id) FILTER (WHERE rn <= 10) AS first_errors
FROM e GROUP BY batch_date
""")
def q_error_digest(spark, sf):
    from quarry.operators.ledger import error_digest
    e = table(spark, sf, "events").where(F.col("event_type") == "error")
    return error_digest(e.select(F.to_date("ts").alias("batch_date"), "event_id",
                                 F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("props")).alias("msg")),
                        "batch_date", "event_id", "msg", 10)


ATTEMPTS_SQL = """
att AS (SELECT user_id, event_type <> 'error' AS ok,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events)
"""


@register("retry_rollup", sql=f"""
WITH {ATTEMPTS_SQL}
SELECT user_id, CAST(min(attempt) FILTER (WHERE ok) AS BIGINT) AS recovered_at, CAST(max(attempt) AS BIGINT) AS attempts,
       CASE WHEN min(attempt) FILTER (WHERE ok) IS NULL THEN 'failed'
            WHEN min(attempt) FILTER (WHERE ok) = 1 THEN 'ok' ELSE 'recovered' END AS status,
       CAST(coalesce(min(attempt) FILTER (WHERE ok), max(attempt)) AS BIGINT) AS attempts_used
FROM att GROUP BY user_id
""")
def q_retry_rollup(spark, sf):
    from quarry.operators.ledger import retry_rollup
    e = table(spark, sf, "events")
    return retry_rollup(e.select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok")),
                        "user_id", ["ts", "event_id"])


@register("fetch_summary", sql=f"""
WITH {ATTEMPTS_SQL},
per AS (SELECT user_id, min(attempt) FILTER (WHERE ok) AS first_ok, max(attempt) AS n FROM att GROUP BY user_id),
day_att AS (SELECT CAST(ts AS DATE) AS day, event_type <> 'error' AS ok,
                   row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS attempt FROM events),
days AS (SELECT day, min(attempt) FILTER (WHERE ok) AS first_ok, count(*) FILTER (WHERE NOT ok) AS outages FROM day_att GROUP BY day)
SELECT CAST(count(*) AS BIGINT) AS ids, CAST((SELECT count(*) FROM events) AS BIGINT) AS attempts,
       CAST(count(*) FILTER (WHERE first_ok = 1) AS BIGINT) AS first_try,
       CAST(sum(CASE WHEN first_ok > 1 THEN first_ok - 1 ELSE 0 END) AS BIGINT) AS retries,
       CAST(count(*) FILTER (WHERE first_ok > 1) AS BIGINT) AS recovered,
       CAST(count(*) FILTER (WHERE first_ok IS NULL) AS BIGINT) AS failed,
       round(coalesce(count(*) FILTER (WHERE first_ok > 1) * 100.0 / nullif(sum(CASE WHEN first_ok > 1 THEN first_ok - 1 ELSE 0 END), 0), 0), 6) AS recovery_rate,
       CAST((SELECT count(*) FROM labels WHERE quality = 1) AS BIGINT) AS skipped,
       CAST((SELECT count(*) FROM days WHERE outages > 0) AS BIGINT) AS outage_batches,
       (SELECT round(coalesce(count(*) FILTER (WHERE outages > 0 AND first_ok > 1) * 100.0 / nullif(count(*) FILTER (WHERE outages > 0), 0), 0), 6)
        FROM days) AS outage_recovery_rate
FROM per
""")
def q_fetch_summary(spark, sf):
    from quarry.operators.ledger import fetch_summary, retry_rollup
    e = table(spark, sf, "events")
    per = retry_rollup(e.select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok")),
                       "user_id", ["ts", "event_id"])
    skipped = table(spark, sf, "labels").where(F.col("quality") == 1)
    return fetch_summary(per, e, skipped, q_outage_rollup(spark, sf))


@register("outage_rollup", sql="""
WITH a AS (SELECT CAST(ts AS DATE) AS batch_date, event_type = 'error' AS outage,
                  row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS attempt FROM events)
SELECT batch_date, CAST(count(*) AS BIGINT) AS attempts, CAST(count(*) FILTER (WHERE outage) AS BIGINT) AS outages,
       CAST(min(attempt) FILTER (WHERE NOT outage) AS BIGINT) AS first_ok_attempt,
       CASE WHEN min(attempt) FILTER (WHERE NOT outage) IS NULL THEN 'failed'
            WHEN min(attempt) FILTER (WHERE NOT outage) = 1 THEN 'ok' ELSE 'recovered' END AS status,
       CAST(coalesce(min(attempt) FILTER (WHERE NOT outage), count(*)) - 1 AS BIGINT) AS retries_used
FROM a GROUP BY batch_date
""")
def q_outage_rollup(spark, sf):
    from quarry.operators.ledger import outage_rollup
    e = table(spark, sf, "events")
    return outage_rollup(e.select(F.to_date("ts").alias("batch_date"), "ts", "event_id",
                                  (F.col("event_type") == "error").alias("outage")),
                         "batch_date", ["ts", "event_id"])


@register("mean_entry_tokens", sql=f"""
SELECT round(coalesce(avg(len({tokens_sql('text')})), 0), 6) AS mean_tokens FROM documents
""")
def q_mean_entry_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.round(F.coalesce(F.avg(T.token_count("text")), F.lit(0.0)), 6).alias("mean_tokens"))


@register("validation_report", sql=f"""
WITH {DECISIONS_SQL}, {VALIDATED_SQL},
i AS (SELECT doc_id, error FROM v WHERE error IS NOT NULL ORDER BY doc_id LIMIT 10)
SELECT CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (WHERE error IS NULL) AS BIGINT) AS valid,
       CAST(count(*) FILTER (WHERE error IS NOT NULL) AS BIGINT) AS invalid,
       CAST(count(*) FILTER (WHERE error IS NULL AND empty) AS BIGINT) AS valid_no_content,
       (SELECT list(error ORDER BY doc_id) FROM i) AS first_errors
FROM v
""")
def q_validation_report(spark, sf):
    return Q.validation_report(_validated(spark, sf), "doc_id")


@register("failure_streak", sql="""
WITH s AS (SELECT user_id, max(ts) FILTER (WHERE event_type <> 'error') AS last_ok FROM events GROUP BY user_id)
SELECT e.user_id, CAST(count(*) FILTER (WHERE e.event_type = 'error' AND (s.last_ok IS NULL OR e.ts > s.last_ok)) AS BIGINT) AS streak
FROM events e JOIN s USING (user_id) GROUP BY e.user_id
""")
def q_failure_streak(spark, sf):
    from quarry.operators.ledger import failure_streak
    e = table(spark, sf, "events")
    return failure_streak(e.select("user_id", "ts", (F.col("event_type") != "error").alias("ok")), "user_id", "ts")


# ------------------------------------------------------------------ windows / order
@register("latest_wins", sql="""
SELECT user_id, event_id, ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def q_latest_wins(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return R.latest_wins(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])


@register("assign_batches", sql="""
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS position,
       CAST((row_number() OVER (ORDER BY doc_id) - 1) // 50 AS BIGINT) AS batch_index
FROM documents
""")
def q_assign_batches(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return R.assign_batches(d, ["doc_id"], 50).select("doc_id", "position", "batch_index")


@register("checkpoint_marks", sql="""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS item_no,
                  sum(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_value
           FROM events)
SELECT event_id, CAST(item_no AS BIGINT) AS item_no, round(running_value, 6) AS running_value FROM r WHERE item_no % 1000 = 0
""")
def q_checkpoint_marks(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    r = R.running_totals(e, ["event_id"], "value", "running_value")
    return r.where(F.col("item_no") % 1000 == 0).select("event_id", "item_no",
                                                         F.round("running_value", 6).alias("running_value"))


@register("batch_progress", sql="""
WITH b AS (SELECT CAST(ts AS DATE) AS batch_date, sum(value) AS seconds FROM events GROUP BY 1),
r AS (SELECT batch_date, row_number() OVER (ORDER BY batch_date) AS n, count(*) OVER () AS total,
             avg(seconds) OVER (ORDER BY batch_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mean_s FROM b)
SELECT batch_date, CAST(n AS BIGINT) AS batch_no, round(n * 100.0 / total, 6) AS percent_done, round(mean_s, 6) AS mean_seconds,
       round(mean_s * (total - n), 6) AS eta_seconds
FROM r
""")
def q_batch_progress(spark, sf):
    from quarry.operators.ledger import batch_progress
    e = table(spark, sf, "events")
    b = e.groupBy(F.to_date("ts").alias("batch_date")).agg(F.sum("value").alias("seconds"))
    return batch_progress(b, "batch_date", "seconds")


@register("keep_recent_runs", sql="""
SELECT event_type, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 100
""")
def q_keep_recent_runs(spark, sf):
    from quarry.operators.retrieval import top_k_per_group
    e = table(spark, sf, "events").select("event_type", "event_id", "ts")
    return top_k_per_group(e, ["event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 100, "_rn").drop("_rn")


@register("paginate", sql="""
WITH p AS (SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100),
t AS (SELECT count(*) AS total FROM documents)
SELECT doc_id, source, CAST(total AS BIGINT) AS total, CAST(greatest(ceil(total / 50.0), 1) AS BIGINT) AS pages FROM p, t
""")
def q_paginate(spark, sf):
    index = R.PageIndex(table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"])
    return index.page(3, 50).select("doc_id", "source", F.lit(index.total).cast("long").alias("total"),
                                    F.lit(index.pages(50)).cast("long").alias("pages"))


@register("paginate_filtered", sql=f"""
WITH {DECISIONS_SQL},
f AS (SELECT doc_id, NativeId, DateDecision, OrganizationName FROM decisions
      WHERE substr(DateDecision, 1, 10) BETWEEN '2024-01-05' AND '2024-02-20' AND ClassificationCode = 'EN')
SELECT *, CAST((SELECT count(*) FROM f) AS BIGINT) AS total FROM f ORDER BY doc_id LIMIT 25 OFFSET 25
""")
def q_paginate_filtered(spark, sf):
    from quarry.operators.search_filters import metadata_filter
    rows = metadata_filter(_decisions(spark, sf), "DateDecision", "2024-01-05", "2024-02-20", {"ClassificationCode": "EN"})
    total = rows.count()
    return R.paginate(rows, ["doc_id"], 2, 25).select("doc_id", "NativeId", "DateDecision", "OrganizationName",
                                                      F.lit(total).cast("long").alias("total"))


@register("list_runs", sql="""
SELECT event_id, ts, event_type, value FROM events WHERE event_type IN ('error', 'purchase') AND value > 50
ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 20
""")
def q_list_runs(spark, sf):
    e = table(spark, sf, "events")
    return e.where(F.col("event_type").isin("error", "purchase") & (F.col("value") > 50)) \
        .orderBy(F.col("ts").desc_nulls_last(), F.col("event_id").desc()).limit(20) \
        .select("event_id", "ts", "event_type", "value")


@register("distinct_pages", sql="""
WITH u AS (SELECT page_id, url FROM pages
           UNION ALL SELECT page_id + 1000000, regexp_replace(url, '^([^?#]*)(\\?[^#]*)?', '\\1?dup=1') FROM pages),
n AS (SELECT page_id, regexp_replace(url, '^([^?#]*)\\?[^#]*', '\\1') AS url_normalized FROM u)
SELECT url_normalized, min(page_id) AS page_id FROM n GROUP BY url_normalized
""")
def q_distinct_pages(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    dup = p.select((F.col("page_id") + 1000000).alias("page_id"),
                   F.regexp_replace("url", r"^([^?#]*)(\?[^#]*)?", "$1?dup=1").alias("url"))
    u = p.unionByName(dup).select("page_id", T.normalize_url("url").alias("url_normalized"))
    return R.distinct_by_min(u, "url_normalized", "page_id")


@register("union_recovered", sql="""
SELECT doc_id, 'first_pass' AS pass FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL
SELECT doc_id, 'recovered' AS pass FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang = 'en'
""")
def q_union_recovered(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    lab = table(spark, sf, "labels").select("doc_id")
    first = d.join(lab, "doc_id", "left_semi").select("doc_id", F.lit("first_pass").alias("pass"))
    rec = d.join(lab, "doc_id", "left_anti").where(F.col("lang") == "en").select("doc_id", F.lit("recovered").alias("pass"))
    return first.unionByName(rec)


@register("distinct_content", sql="""
SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 1
""")
def q_distinct_content(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
