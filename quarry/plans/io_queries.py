"""Registered source and sink queries (rows 1-6, 8-18 of the inventory).

Each writes below the shared checkpoint folder, reads back, and returns the
read-back rows, so the oracle checks the round trip by value."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import relational as R
from quarry.plans.registry import register
from quarry.plans.relational_queries import STORE_SQL, _store
from quarry.session import shared_table
from quarry.sources import io
from quarry.sources.chunk_store import ChunkStore
from quarry.sources.decisions import DECISIONS_SQL, decisions_from_documents
from quarry.sources.tables import table

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@register("read_documents", sql=f"""
WITH {DECISIONS_SQL} SELECT NativeId, Title, DateDecision FROM decisions
""")
def q_read_documents(spark, sf):
    d = decisions_from_documents(table(spark, sf, "documents")).drop("doc_id")
    path = io.new_scratch(spark, "decisions-json")
    d.write.mode("overwrite").json(path + "/good")
    spark.createDataFrame([("{not json",)], "value string").write.mode("overwrite").text(path + "/bad")
    schema = "NativeId string, Title string, Content string, DateDecision string"
    return io.read_documents(spark, path + "/*", schema).select("NativeId", "Title", "DateDecision")


ARCHIVE_SQL = """
arch AS (SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS native_id,
                '{"status":"' || o_orderstatus || '","key":' || CAST(o_orderkey AS VARCHAR) || '}' AS data,
                strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS batch_start,
                strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS batch_end,
                o_orderdate
         FROM orders)
"""


def _archive_rows(spark, sf):
    o = table(spark, sf, "orders")
    m = F.date_trunc("month", "o_orderdate")
    return o.select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("native_id"),
                    F.col("o_orderdate").cast("timestamp").alias("fetched_at"),
                    F.concat(F.lit('{"status":"'), F.col("o_orderstatus"), F.lit('","key":'),
                             F.col("o_orderkey").cast("string"), F.lit("}")).alias("data"),
                    F.date_format(m, "yyyy-MM-dd").alias("batch_start"),
                    F.date_format(F.add_months(m, 1), "yyyy-MM-dd").alias("batch_end"))


@register("read_raw_archive", sql=f"""
WITH {ARCHIVE_SQL} SELECT native_id, data, batch_start, batch_end FROM arch
""")
def q_read_raw_archive(spark, sf):
    path = io.new_scratch(spark, "archive")
    io.write_raw_archive(_archive_rows(spark, sf), path)
    return io.read_raw_archive(spark, path).select("native_id", "data", "batch_start", "batch_end")


@register("write_raw_archive", sql=f"""
WITH {ARCHIVE_SQL}
SELECT native_id, CASE WHEN batch_start = '1996-01-01' THEN replace(data, '"status"', '"rerun"') ELSE data END AS data,
       batch_start FROM arch
""")
def q_write_raw_archive(spark, sf):
    """A re-run of one window replaces exactly that window."""
    path = io.new_scratch(spark, "archive-rerun")
    rows = _archive_rows(spark, sf)
    io.write_raw_archive(rows, path)
    rerun = rows.where(F.col("batch_start") == "1996-01-01") \
        .withColumn("data", F.replace("data", F.lit('"status"'), F.lit('"rerun"')))
    io.write_raw_archive(rerun, path)
    return io.read_raw_archive(spark, path).select("native_id", "data", "batch_start")


@register("normalize_payload", sql="""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 'ORD-' || CAST(o_orderkey AS VARCHAR) END AS native_id
FROM orders
""")
def q_normalize_payload(spark, sf):
    o = table(spark, sf, "orders")
    nid = F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string"))
    raw = (F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('{"NativeId":"'), nid, F.lit('","Title":"t"}')))
           .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit('{"decisions":[{"NativeId":"'), nid, F.lit('"},{"NativeId":"x"}]}')))
           .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit(' [{"NativeId":"'), nid, F.lit('"}]')))
           .otherwise(F.lit('{"count":0}')))
    doc = io.normalize_payload(raw)
    return o.select("o_orderkey", F.get_json_object(doc, "$.NativeId").alias("native_id"))


@register("list_document_ids", sql="""
SELECT o_custkey, 'ORD-' || CAST(o_orderkey AS VARCHAR) AS NativeId, o_orderpriority AS Title FROM orders
""")
def q_list_document_ids(spark, sf):
    o = table(spark, sf, "orders")
    listing = o.groupBy("o_custkey").agg(F.collect_list(F.struct(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("NativeId"),
        F.col("o_orderpriority").alias("Title"))).alias("decisions"))
    return io.list_document_ids(listing).select("o_custkey", "NativeId", "Title")


@register("listing_totals", sql="""
SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS BIGINT) AS returned, CAST(count(*) AS BIGINT) AS total,
       count(*) FILTER (WHERE o_orderkey % 7 <> 0) >= count(*) AS complete
FROM orders GROUP BY o_custkey
""")
def q_listing_totals(spark, sf):
    """Listing pages of a customer and a month; the source left every seventh order out of its lists."""
    o = table(spark, sf, "orders")
    entry = F.struct(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("NativeId"))
    pages = o.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(
        F.collect_list(F.when(F.col("o_orderkey") % 7 != 0, entry)).alias("decisions"), F.count(F.lit(1)).alias("count"))
    return io.listing_totals(pages, ["o_custkey"])


@register("tabular_entries_unique", sql="""
WITH e AS (SELECT replace(c_mktsegment, ' ', '_') AS name, 'Untitled' || chr(10) || chr(10) || chr(10) || chr(10) || 'c_name: ' || c_name AS content
           FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY encode(content)) AS rn FROM e)
SELECT content, CASE WHEN rn = 1 THEN name ELSE name || '_' || rn END AS file_name FROM n
""")
def q_tabular_entries_unique(spark, sf):
    """Entries named by one of five segments, each name made to occur once."""
    return io.tabular_entries(table(spark, sf, "customer"), ["c_name"], None, "c_mktsegment", unique=True) \
        .select("content", "file_name")


@register("tabular_entries", sql="""
SELECT replace(translate(c_name, '/\\:', '___'), ' ', '_') AS file_name,
       c_name || chr(10) || chr(10) || chr(10) || chr(10) || 'c_mktsegment: ' || c_mktsegment || ' '
       || chr(10) || chr(10) || 'c_acctbal: ' || CAST(c_acctbal AS VARCHAR) AS content
FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def q_tabular_entries(spark, sf):
    path = io.new_scratch(spark, "customer-csv")
    table(spark, sf, "customer").write.mode("overwrite").option("header", True).csv(path)
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return io.tabular_entries(df, ["c_mktsegment", "c_acctbal"], "c_name", "c_name",
                              filter_field="c_mktsegment", filter_value="BUILDING").select("file_name", "content")


@register("event_entries", sql="""
WITH ev AS (SELECT e.event_id, e.event_type || ' ' || CAST(e.event_id AS VARCHAR) AS name_fi, e.ts AS start_time,
                   e.ts + to_minutes(CAST(floor(e.value) AS BIGINT)) AS end_time, 'Paikka ' || CAST(e.user_id AS VARCHAR) AS location_fi,
                   CASE WHEN e.user_id % 2 = 1 THEN 'Katu ' || CAST(e.user_id AS VARCHAR) END AS street_fi,
                   CASE WHEN e.event_id % 2 = 0 THEN json_extract_string(e.props, '$.k') END AS description_fi,
                   CASE WHEN e.event_id % 3 = 0 THEN p.url END AS location_url,
                   CASE WHEN e.event_id % 3 = 0 THEN regexp_extract(p.html, '<h1>([^<]*)</h1>', 1) END AS main_text
            FROM events e LEFT JOIN pages p ON p.page_id = e.user_id),
c AS (SELECT event_id, start_time, name_fi,
  'Tapahtuma: ' || name_fi || chr(10) || ', ' || chr(10) || 'Päivämäärä: ' || strftime(start_time, '%d.%m.%Y')
  || chr(10) || ', ' || chr(10) || 'Aika: ' || strftime(start_time, '%H:%M') || ' - ' || strftime(end_time, '%H:%M')
  || chr(10) || ', ' || chr(10) || 'Paikka: ' || location_fi || ', ' || coalesce(street_fi, 'No Address')
  || chr(10) || ', ' || chr(10) || 'Kuvaus: ' || coalesce(nullif(description_fi, ''), CASE WHEN location_url IS NOT NULL THEN coalesce(main_text, 'None') END, 'None') AS content
FROM ev)
SELECT event_id, content, replace(translate(strftime(start_time, '%Y-%m-%d') || '_' || substr(name_fi, 1, 6), '/\\:', '___'), ' ', '_')
       || '_' || substr(sha256(content), 1, 12) AS file_name
FROM c
""")
def q_event_entries(spark, sf):
    """Events written as feed responses (nested JSON) and read back."""
    e = table(spark, sf, "events")
    pages = table(spark, sf, "pages")
    name = F.struct(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("fi"))
    end = F.timestamp_add("MINUTE", F.floor("value").cast("int"), "ts")
    street = F.when(F.col("user_id") % 2 == 1, F.concat(F.lit("Katu "), F.col("user_id").cast("string")))
    place = F.struct(F.when(F.col("event_id") % 3 == 0, F.col("url")).alias("@id"),
                     F.struct(F.concat(F.lit("Paikka "), F.col("user_id").cast("string")).alias("fi")).alias("name"),
                     F.struct(street.alias("fi")).alias("street_address"))
    described = F.struct(F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).alias("fi"))
    event = F.struct(name.alias("name"), F.col("ts").cast("string").alias("start_time"), end.cast("string").alias("end_time"),
                     place.alias("location"), described.alias("description"))
    feed = e.join(pages.select("page_id", "url"), e["user_id"] == pages["page_id"], "left") \
        .select("event_id", F.to_json(F.struct(F.array(event).alias("data"))).alias("value"))
    path = io.new_scratch(spark, "event-feed")
    feed.write.json(path)
    page_text = pages.select("url", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("main_text"))
    back = io.event_feed(spark.read.schema(feed.schema).json(path))
    return io.event_entries(back, page_text).select("event_id", "content", "file_name")


@register("read_eval_pairs", sql=f"""
WITH q AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS q,
                  arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, CASE WHEN a IS NULL THEN q ELSE q || chr(10) || '---' || chr(10) || a END || chr(10) AS v FROM q WHERE q IS NOT NULL),
s AS (SELECT conv_id, string_split(v, '---') AS parts FROM f)
SELECT conv_id, CASE WHEN len(parts) = 2 THEN {STRIP.format(x='parts[1]')} END AS question,
       CASE WHEN len(parts) = 2 THEN {STRIP.format(x='parts[2]')} END AS answer,
       CASE WHEN len(parts) <> 2 THEN 'expected exactly one ''---'' separator' END AS error
FROM s
""")
def q_read_eval_pairs(spark, sf):
    c = table(spark, sf, "conversations")
    firsts = c.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("q"),
        F.min_by(F.when(F.col("role") == "assistant", F.col("text")),
                 F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"))
    files = firsts.where(F.col("q").isNotNull()).select(
        "conv_id", F.when(F.col("a").isNull(), F.col("q"))
        .otherwise(F.concat("q", F.lit("\n---\n"), "a")).alias("value"))
    path = io.new_scratch(spark, "eval-pairs")
    files.write.mode("overwrite").json(path)  # many pairs a file
    return io.eval_pairs(spark.read.schema(files.schema).json(path)).select("conv_id", "question", "answer", "error")


@register("write_valid_documents", sql=f"""
WITH {DECISIONS_SQL}
SELECT NativeId, Title, coalesce(substr(DateDecision, 1, 10), 'unknown') AS day FROM decisions
""")
def q_write_valid_documents(spark, sf):
    d = decisions_from_documents(table(spark, sf, "documents")).drop("doc_id")
    bad = spark.createDataFrame([("  ", "t", None, None), ("X-1", "", "", None), ("X-2", "t", "c", "2024-02-30")],
                                "NativeId string, Title string, Content string, DateDecision string")
    src = d.unionByName(bad, allowMissingColumns=True)
    path = io.new_scratch(spark, "valid-docs")
    out = io.write_valid_documents(src, path, path + "-rejects")
    return out.select("NativeId", "Title", F.col("day").cast("string").alias("day"))


@register("write_embeddings", sql="""
SELECT 'vec-' || CAST(vec_id AS VARCHAR) AS chunk_id, 'DOC-' || CAST(vec_id // 10 AS VARCHAR) AS native_id, embedding,
       'hash-64' AS embedding_model, CAST(len(embedding) AS INTEGER) AS embedding_dimensions, 'label_' || CAST(label AS VARCHAR) AS window
FROM embeddings
""")
def q_write_embeddings(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("DOC-"), F.floor(F.col("vec_id") / 10).cast("string")).alias("native_id"),
        "embedding", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("window"))
    path = io.new_scratch(spark, "embeddings-export")
    back = io.write_embeddings(e, path, "hash-64")
    return back.select("chunk_id", "native_id", "embedding", "embedding_model", "embedding_dimensions",
                       F.col("window").cast("string").alias("window"))


@register("upsert_chunks", sql="""
WITH base AS (SELECT 'vec-' || CAST(vec_id AS VARCHAR) AS chunk_id, 'DOC-' || CAST(vec_id // 10 AS VARCHAR) AS native_id, label FROM embeddings),
ch AS (SELECT 'vec-' || CAST(vec_id AS VARCHAR) AS chunk_id, 'NEW-' || CAST(vec_id AS VARCHAR) AS native_id, label + 100 AS label
       FROM embeddings WHERE label = 3
       UNION ALL SELECT 'extra-' || CAST(vec_id AS VARCHAR), 'NEW-' || CAST(vec_id AS VARCHAR), label FROM embeddings WHERE label = 4)
SELECT * FROM base WHERE chunk_id NOT IN (SELECT chunk_id FROM ch) UNION ALL SELECT * FROM ch
""")
def q_upsert_chunks(spark, sf):
    e = table(spark, sf, "embeddings")
    base = e.select(F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("chunk_id"),
                    F.concat(F.lit("DOC-"), F.floor(F.col("vec_id") / 10).cast("string")).alias("native_id"), "label")
    changed = e.where(F.col("label") == 3).select(
        F.concat(F.lit("vec-"), F.col("vec_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("NEW-"), F.col("vec_id").cast("string")).alias("native_id"), (F.col("label") + 100).alias("label"))
    added = e.where(F.col("label") == 4).select(
        F.concat(F.lit("extra-"), F.col("vec_id").cast("string")).alias("chunk_id"),
        F.concat(F.lit("NEW-"), F.col("vec_id").cast("string")).alias("native_id"), "label")
    path = io.new_scratch(spark, "chunk-store")
    io.upsert_chunks(path, base, "chunk_id")
    io.upsert_chunks(path, changed.unionByName(added), "chunk_id")
    return ChunkStore(spark, path).read().select("chunk_id", "native_id", "label")


URGENT_IDS = "SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority = '1-URGENT'"


def _urgent_ids(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT") \
        .select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("id"))


@register("delete_document", sql=f"""
WITH {STORE_SQL}, ids AS ({URGENT_IDS})
SELECT native_id, decision_native_id FROM store
WHERE native_id NOT IN (SELECT id FROM ids) AND coalesce(decision_native_id, '') NOT IN (SELECT id FROM ids)
""")
def q_delete_document(spark, sf):
    return R.delete_document(_store(spark, sf), _urgent_ids(spark, sf), "id")


@register("delete_attachments", sql=f"""
WITH {STORE_SQL}, ids AS ({URGENT_IDS})
SELECT native_id, decision_native_id FROM store
WHERE NOT (decision_native_id IS NOT NULL AND decision_native_id IN (SELECT id FROM ids))
""")
def q_delete_attachments(spark, sf):
    s = _store(spark, sf).withColumn("is_attachment", F.col("decision_native_id").isNotNull())
    return R.delete_attachments(s, _urgent_ids(spark, sf)).drop("is_attachment")


@register("delete_many", sql=f"""
WITH {STORE_SQL}, ids AS ({URGENT_IDS} UNION ALL SELECT 'MISSING-' || CAST(n_nationkey AS VARCHAR) FROM nation)
SELECT CAST((SELECT count(*) FROM ids) AS BIGINT) AS total, CAST((SELECT count(*) FROM ids) AS BIGINT) AS deleted,
       CAST(0 AS BIGINT) AS failed,
       CAST((SELECT count(*) FROM store WHERE native_id IN (SELECT id FROM ids)
                                           OR decision_native_id IN (SELECT id FROM ids)) AS BIGINT) AS rows_removed
""")
def q_delete_many(spark, sf):
    """Deletes from a stored table and counts what the new version holds."""
    ids = _urgent_ids(spark, sf).unionByName(table(spark, sf, "nation").select(
        F.concat(F.lit("MISSING-"), F.col("n_nationkey").cast("string")).alias("id")))
    store = shared_table(_store(spark, sf), "store")
    return R.delete_counts(store, shared_table(R.delete_document(store, ids), "store"), ids)


@register("full_refresh_publish", sql="""
WITH e AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1),
d AS (SELECT d.doc_id, d.text FROM documents d JOIN e USING (doc_id))
SELECT 'docs' AS collection, CAST(count(*) AS BIGINT) AS entries,
       round(coalesce(avg(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> ''))), 0), 6) AS mean_tokens
FROM d
""")
def q_full_refresh_publish(spark, sf):
    from quarry.plans.publish import full_refresh_publish
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    path = io.new_scratch(spark, "knowledge")
    return full_refresh_publish(d, path, "docs")


@register("fan_out_write", sql="""
SELECT CAST(count(*) AS BIGINT) AS success, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS n_errors FROM documents
""")
def q_fan_out_write(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    base = io.new_scratch(spark, "fanout")
    res = io.fan_out_write(d, [base + "/a", base + "/b"])
    return io.merge_store_results(res).select(F.col("success").cast("long").alias("success"),
                                              F.col("failed").cast("long").alias("failed"),
                                              F.size("errors").cast("long").alias("n_errors"))


@register("publish_from_config", sql="""
SELECT * FROM (VALUES ('csv_excel', 'customers'), ('web', 'pages'), ('events_api', 'events')) t(type, collection) JOIN (
  SELECT 'customers' AS collection, CAST(count(DISTINCT (c_name, c_mktsegment)) AS BIGINT) AS entries, false AS failed FROM customer
  UNION ALL SELECT 'pages', CAST(count(DISTINCT regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS BIGINT), false FROM pages
  UNION ALL SELECT 'events', CAST(count(DISTINCT (event_type, date_trunc('minute', ts))) AS BIGINT), false FROM events) USING (collection)
UNION ALL SELECT 'no_such_type', 'none', CAST(0 AS BIGINT), true
""")
def q_publish_from_config(spark, sf):
    """Four configs published, one of them wrong: it fails alone."""
    from quarry.operators import html_jobs
    from quarry.plans.publish import publish_all
    none = F.lit(None).cast("string")
    sources = {
        "csv_excel": lambda s, c: io.tabular_entries(table(s, sf, "customer"), ["c_mktsegment"], "c_name", "c_name"),
        "web": lambda s, c: html_jobs.page_entries(table(s, sf, "pages"), "h1", ("h1",), "h1"),
        "events_api": lambda s, c: io.event_entries(table(s, sf, "events").select(
            F.col("event_type").alias("name_fi"), F.col("ts").alias("start_time"), F.col("ts").alias("end_time"),
            none.alias("location_fi"), none.alias("street_fi"), none.alias("description_fi"), none.alias("location_url")))}
    configs = [{"type": "csv_excel", "collection": "customers", "data": {"prefix": "c_"}},
               {"type": "no_such_type", "collection": "none"}, {"type": "web", "collection": "pages"},
               {"type": "events_api", "collection": "events"}]
    done = publish_all(spark, configs, sources, io.new_scratch(spark, "knowledge"))
    return done.select("type", "collection", "entries", F.col("error").isNotNull().alias("failed"))


@register("import_from_config")
def q_import_from_config(spark, sf):
    """Three configs (csv_excel, web, events_api) over the landed tables;
    each source is one Spark job, results unioned with the config name."""
    from quarry.operators import html_jobs
    from quarry.plans.publish import import_from_config

    def csv_source(s, cfg):
        df = table(s, sf, "customer")
        d = cfg["data"]
        return io.tabular_entries(df, d["content_fields"], d["entry_config"]["title_field"],
                                  d["entry_config"]["file_name_field"])

    def web_source(s, cfg):
        return html_jobs.page_entries(table(s, sf, "pages"), "h1", ("article",), "h1").select("content", "file_name")

    def events_source(s, cfg):
        e = table(s, sf, "events").select(
            "event_id", F.col("event_type").alias("name_fi"), F.col("ts").alias("start_time"),
            F.col("ts").alias("end_time"), F.lit(None).cast("string").alias("location_fi"),
            F.lit(None).cast("string").alias("street_fi"), F.col("props").alias("description_fi"),
            F.lit(None).cast("string").alias("location_url"))
        return io.event_entries(e).select("content", "file_name")

    sources = {"csv_excel": csv_source, "web": web_source, "events_api": events_source}
    configs = [{"type": "csv_excel", "data": {"prefix": "excel_", "content_fields": ["c_mktsegment", "c_acctbal"],
                                              "entry_config": {"title_field": "c_name", "file_name_field": "c_name"}}},
               {"type": "web", "data": {"prefix": "web_"}},
               {"type": "events_api", "data": {"prefix": "event_"}}]
    out = None
    for cfg in configs:
        part = import_from_config(spark, cfg, sources).select("content", "file_name") \
            .withColumn("config", F.lit(cfg["type"]))
        out = part if out is None else out.unionByName(part)
    return out
