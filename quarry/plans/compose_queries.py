"""Registered composed jobs: embedding plugin, evaluation, prompts, crawl
frontier and the full ingestion pipeline (rows 40, 91, 93-95)."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.operators.embedding import embed_texts
from quarry.operators.evaluation import cosine_scores, judge_answers, overlap_judge, turn_pairs
from quarry.operators.graph import crawl_frontier
from quarry.plans import search, search_queries  # noqa: F401 (hash_embed oracle is reused)
from quarry.plans.registry import ORACLES, register
from quarry.plans.sql_fragments import CHUNK_TOKENS_CTE, QUERY_BUCKETS_CTE, bucket_sql, tokens_sql
from quarry.session import shared_table
from quarry.sources.decisions import DECISIONS_SQL, decisions_from_documents
from quarry.sources.tables import table

#: Settings of these queries: the system message, and the start of title requests, which get none.
SYSTEM_TEMPLATE = ("Answer the question from the data below. If it does not hold the answer, say so."
                   "\n\nDATA: {context}")
TITLE_PROMPT_PREFIX = "Here is the query:"


@lru_cache(maxsize=1 << 17)
def _md5_number(token: str) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16)


def md5_hash_embedder(dims: int = 64):
    """Plugin for embed_texts: the offline md5 feature-hash embedder in NumPy."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.bincount([_md5_number(tok) % dims for tok in (t or "").split()], minlength=dims).astype(float)
            n = np.linalg.norm(v)
            out.append((v / n).tolist() if n > 0 else None)
        return out
    return embed


@register("embed_texts")
def q_embed_texts(spark, sf):
    b = table(spark, sf, "benchmark")
    e = embed_texts(b, "text", "item_id", md5_hash_embedder(64), batch_size=100)
    return e.where(F.col("embedding").isNotNull()) \
        .select("item_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@register("eval_scores", sql=f"""
WITH a AS (SELECT conv_id, turn, min(text) AS expected FROM conversations WHERE role = 'assistant' GROUP BY ALL),
g AS (SELECT conv_id, turn - 2 AS turn, min(text) AS generated FROM conversations GROUP BY ALL),
p AS (SELECT a.conv_id, a.turn, expected, generated, {tokens_sql('expected')} AS et, {tokens_sql('generated')} AS gt
      FROM a LEFT JOIN g ON a.conv_id = g.conv_id AND a.turn = g.turn),
t AS (SELECT conv_id, turn, 'm' AS side, unnest(et) AS tok FROM p WHERE generated IS NOT NULL
      UNION ALL SELECT conv_id, turn, 'g', unnest(gt) FROM p WHERE generated IS NOT NULL),
b AS (SELECT conv_id, turn, side, {bucket_sql('tok')} AS b, count(*) AS c FROM t GROUP BY ALL),
n AS (SELECT conv_id, turn, side, sqrt(sum(c * c)) AS n FROM b GROUP BY ALL),
d AS (SELECT conv_id, turn, sum(m.c * o.c) AS dp FROM (FROM b WHERE side = 'm') m JOIN (FROM b WHERE side = 'g') o
      USING (conv_id, turn, b) GROUP BY ALL),
s AS (SELECT conv_id, turn, round(coalesce(d.dp, 0) / (nm.n * ng.n), 6) AS cosine
      FROM (FROM n WHERE side = 'm') nm JOIN (FROM n WHERE side = 'g') ng USING (conv_id, turn) LEFT JOIN d USING (conv_id, turn)),
j AS (SELECT conv_id, turn, len(list_intersect(et, gt)) AS shared, len(list_distinct(list_concat(et, gt))) AS every
      FROM p WHERE generated IS NOT NULL)
SELECT p.conv_id, p.turn, s.cosine, CAST(CASE WHEN every > 0 THEN 10 * shared // every ELSE 0 * shared END AS DOUBLE) AS judge_score,
       shared || ' of ' || every || ' words shared' AS feedback,
       CASE WHEN p.generated IS NULL THEN 'no generated answer' END AS error
FROM p LEFT JOIN s USING (conv_id, turn) LEFT JOIN j USING (conv_id, turn)
""")
def q_eval_scores(spark, sf):
    """Every answer against the text two turns on: cosine and the offline judge."""
    pairs = turn_pairs(table(spark, sf, "conversations"))
    return judge_answers(cosine_scores(pairs), overlap_judge).drop("expected", "generated")


def _prompt_sql() -> str:
    tmpl = SYSTEM_TEMPLATE.replace("'", "''").replace("\n", "' || chr(10) || '").replace("{context}", "' || ctx || '")
    return f"""
WITH {CHUNK_TOKENS_CTE}, {QUERY_BUCKETS_CTE},
sc AS (SELECT qb.item_id, cb.doc_id, cb.idx, sum(qb.c * cb.c) AS dp FROM qb JOIN cb USING (b) GROUP BY ALL),
r AS (SELECT sc.item_id, sc.doc_id || '_chunk_' || sc.idx AS chunk_id, sc.doc_id, sc.idx, round(dp / (qn.n * cn.n), 6) AS score
      FROM sc JOIN qn USING (item_id) JOIN cn USING (doc_id, idx)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM r) WHERE rank <= 3),
c AS (SELECT top.item_id, string_agg(array_to_string(w.ctok, ' '), chr(10) || chr(10) ORDER BY top.rank) AS ctx
      FROM top JOIN w USING (doc_id, idx) GROUP BY top.item_id)
SELECT b.item_id, CASE WHEN starts_with(b.text, '{TITLE_PROMPT_PREFIX}') THEN NULL ELSE '{tmpl}' END AS system_content,
       b.text AS user_content
FROM benchmark b LEFT JOIN c USING (item_id)
"""


@register("rag_prompts", sql=_prompt_sql())
def q_rag_prompts(spark, sf):
    from quarry.plans.prompts import rag_prompts
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    hits = shared_table(retrieval.knn_search(search.chunk_vectors(docs), search.query_vectors(bench), 3, qid="item_id",
                                             carry=["doc_id"]), "hits")
    hits = search.hit_texts(hits, docs)
    msgs = rag_prompts(bench.select("item_id", "text"), hits, "item_id", "text", SYSTEM_TEMPLATE, TITLE_PROMPT_PREFIX)
    return msgs.select("item_id", "system_content", "user_content")


@register("crawl_frontier", sql="""
WITH RECURSIVE l AS (SELECT DISTINCT 'S' || l_suppkey AS s, 'P' || l_partkey AS p, l_linenumber AS n FROM lineitem),
e AS (SELECT s AS src, p AS dst FROM l WHERE n = 1 UNION SELECT p, s FROM l WHERE n = 2),
r(node, depth) USING KEY (node) AS (
  SELECT 'S1', CAST(0 AS BIGINT) UNION
  SELECT e.dst, min(r.depth) + 1 FROM r JOIN e ON e.src = r.node
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS seen WHERE seen.node = e.dst) GROUP BY e.dst)
SELECT node, depth FROM r
""")
def q_crawl_frontier(spark, sf):
    """All supplier and part keys: a supplier leads to the parts of its first
    lines, a part to the suppliers of second lines."""
    li = table(spark, sf, "lineitem")
    s, p = (F.concat(F.lit(c), F.col(k).cast("string")) for c, k in (("S", "l_suppkey"), ("P", "l_partkey")))
    edges = li.where("l_linenumber = 1").select(s.alias("src"), p.alias("dst")) \
        .unionByName(li.where("l_linenumber = 2").select(p.alias("src"), s.alias("dst")))
    start = spark.range(1).select(F.lit("S1").alias("node"))
    return crawl_frontier(edges, start, "src", "dst")


PIPELINE_SQL = f"""
WITH {DECISIONS_SQL},
src AS (SELECT NativeId, DateDecision, Content FROM decisions
        UNION ALL SELECT 'PAGE-' || CAST(page_id AS VARCHAR),
               strftime(DATE '2024-01-01' + CAST(page_id % 60 AS INTEGER), '%Y-%m-%d'), html FROM pages),
o AS (SELECT NativeId, substr(DateDecision, 1, 10) AS batch_day,
             CASE WHEN NativeId IN (SELECT 'DOC-' || CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1) THEN 'skipped'
                  WHEN coalesce(Content, '') = '' THEN 'failed'
                  WHEN starts_with(NativeId, 'PAGE-') THEN 'successful'
                  WHEN regexp_replace(Content, '^[\\s]+|[\\s]+$', '', 'g') = '' OR regexp_matches(lower(Content), '<html|</html>')
                       OR regexp_matches(regexp_replace(Content, '[\\s\\x0B\\x{{1C}}-\\x{{1F}}\\x{{85}}]', '', 'g'), '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}\\p{{Cs}}]')
                  THEN 'failed' ELSE 'successful' END AS outcome
      FROM src WHERE DateDecision >= '2024-01-01' AND DateDecision < '2024-03-01'),
a AS (SELECT 'DOC-' || CAST(conv_id AS VARCHAR) AS NativeId, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY 1)
SELECT batch_day, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE outcome <> 'skipped') AS BIGINT) AS processed,
       CAST(count(*) FILTER (WHERE outcome = 'successful') AS BIGINT) AS successful,
       CAST(count(*) FILTER (WHERE outcome = 'failed') AS BIGINT) AS failed,
       CAST(count(*) FILTER (WHERE outcome = 'skipped') AS BIGINT) AS skipped,
       CAST(coalesce(sum(a.n) FILTER (WHERE outcome = 'successful'), 0) AS BIGINT) AS attachments
FROM o LEFT JOIN a USING (NativeId) GROUP BY batch_day
"""


def pipeline_inputs(spark, sf):
    """Decisions (documents as plain text, pages as HTML), the ids indexed
    already (good labels) and attachments (conversation turns)."""
    docs = decisions_from_documents(table(spark, sf, "documents", spread=True)).drop("doc_id") \
        .withColumn("is_html", F.lit(False))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 60).cast("int")), "yyyy-MM-dd")
    pages = table(spark, sf, "pages", spread=True).select(
        F.concat(F.lit("PAGE-"), F.col("page_id").cast("string")).alias("NativeId"), F.col("url").alias("Title"),
        F.col("html").alias("Content"), day.alias("DateDecision"), F.lit(True).alias("is_html"))
    known = table(spark, sf, "labels").where(F.col("quality") == 1).select(
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("NativeId"))
    turns = table(spark, sf, "conversations").select(
        F.concat(F.lit("DOC-"), F.col("conv_id").cast("string")).alias("decision_native_id"),
        F.concat(F.lit("att_"), F.col("turn").cast("string")).alias("attachment_native_id"),
        F.lit("https://example.com/turn.txt").alias("FileURI"),
        F.when(F.col("role") == "system", "Salainen").otherwise("Julkinen").alias("PublicityClass"),
        F.lit(None).cast("string").alias("PersonalData"), "text")
    return docs.unionByName(pages, allowMissingColumns=True), known, turns


@register("full_pipeline", sql=PIPELINE_SQL)
def q_full_pipeline(spark, sf):
    from quarry.operators.ledger import ingest_batch_stats
    from quarry.plans.ingest import ingest
    from quarry.sources import io
    decisions, known, turns = pipeline_inputs(spark, sf)
    outcomes = ingest(decisions, known, turns, "2024-01-01", "2024-03-01", md5_hash_embedder(64), model="hash-64",
                      store_path=io.new_scratch(spark, "chunk-store"), export_path=io.new_scratch(spark, "embeddings"))
    return ingest_batch_stats(outcomes).drop("chunks", "attachment_chunks")


# embed_texts uses the same values as hash_embed: reuse its oracle.
ORACLES["embed_texts"] = ORACLES["hash_embed"]
