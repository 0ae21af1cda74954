"""Registered retrieval queries (rows 33-34, 41, 57, 60-62 of the inventory)."""

from __future__ import annotations

from quarry.plans import search
from quarry.plans.registry import register
from quarry.plans.sql_fragments import CHUNK_TOKENS_CTE, QUERY_BUCKETS_CTE
from quarry.session import scratch_path, table_fingerprint
from quarry.sources.tables import table


@register("top_k_per_group", sql=f"""
WITH {CHUNK_TOKENS_CTE}, {QUERY_BUCKETS_CTE},
sc AS (SELECT qb.item_id, cb.doc_id, cb.idx, sum(qb.c * cb.c) AS dp FROM qb JOIN cb USING (b) GROUP BY ALL),
r AS (SELECT sc.item_id, sc.doc_id || '_chunk_' || sc.idx AS chunk_id, sc.doc_id,
             round(dp / (qn.n * cn.n), 6) AS score
      FROM sc JOIN qn USING (item_id) JOIN cn USING (doc_id, idx))
SELECT item_id, rank, chunk_id, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM r)
WHERE rank <= 10
""")
def top_k_per_group(spark, sf_dir):
    """Flagship: benchmark queries -> 10 best document chunks each."""
    return search.benchmark_top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


from pyspark.sql import functions as F  # noqa: E402

from quarry.functions import text as T  # noqa: E402
from quarry.operators import retrieval, threshold  # noqa: E402
from quarry.plans.sql_fragments import bucket_sql, tokens_sql  # noqa: E402
from quarry.sources.decisions import DECISIONS_SQL, decisions_from_documents  # noqa: E402

def _search_sql(where: str = "TRUE") -> str:
    return f"""
WITH {DECISIONS_SQL}, {CHUNK_TOKENS_CTE.strip()}, {QUERY_BUCKETS_CTE},
sc AS (SELECT qb.item_id, cb.doc_id, cb.idx, sum(qb.c * cb.c) AS dp FROM qb JOIN cb USING (b)
       WHERE cb.doc_id IN (SELECT doc_id FROM decisions WHERE {where}) GROUP BY ALL),
r AS (SELECT sc.item_id, sc.doc_id || '_chunk_' || sc.idx AS chunk_id, sc.doc_id, sc.idx,
             round(dp / (qn.n * cn.n), 6) AS score
      FROM sc JOIN qn USING (item_id) JOIN cn USING (doc_id, idx)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM r)
        WHERE rank <= 5)
SELECT top.item_id, CAST(top.rank AS BIGINT) AS rank, top.chunk_id,
       CASE WHEN coalesce(dd.Title, '') <> '' THEN dd.Title ELSE 'Untitled' END AS title,
       substr(array_to_string(w.ctok, ' '), 1, 500) AS snippet, top.score,
       dd.DateDecision AS date_decision, dd.OrganizationName AS organization
FROM top JOIN w USING (doc_id, idx) JOIN decisions dd USING (doc_id)
"""


def _searched(spark, sf):
    """Decisions with their content as ``text``, and the benchmark queries."""
    return (decisions_from_documents(table(spark, sf, "documents")).withColumnRenamed("Content", "text"),
            table(spark, sf, "benchmark"))


@register("search_results", sql=_search_sql())
def q_search_results(spark, sf):
    return search.search(*_searched(spark, sf), 5)


@register("search_results_filtered", sql=_search_sql(
    "substr(DateDecision, 1, 10) BETWEEN '2024-01-05' AND '2024-02-10' AND ClassificationCode = 'EN'"))
def q_search_results_filtered(spark, sf):
    return search.search(*_searched(spark, sf), 5, date_gte="2024-01-05", date_lte="2024-02-10",
                         equals={"ClassificationCode": "EN"})


_EMB_SCORES_SQL = f"""
WITH {QUERY_BUCKETS_CTE},
ev AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS b FROM embeddings),
en AS (SELECT vec_id, sqrt(sum(x::DOUBLE * x::DOUBLE)) AS n FROM ev GROUP BY vec_id),
sc AS (SELECT qb.item_id, ev.vec_id, ev.label, sum(qb.c * ev.x::DOUBLE) AS dp FROM qb JOIN ev USING (b) GROUP BY ALL),
r AS (SELECT sc.item_id, sc.vec_id, sc.label, round(dp / (qn.n * en.n), 6) AS score
      FROM sc JOIN qn USING (item_id) JOIN en USING (vec_id))
"""


@register("knn_search", sql=_EMB_SCORES_SQL + """
SELECT item_id, CAST(rank AS BIGINT) AS rank, vec_id, label, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank FROM r WHERE label <= 4)
WHERE rank <= 10
""")
def q_knn_search(spark, sf):
    emb = table(spark, sf, "embeddings").where(F.col("label") <= 4)
    q = search.query_vectors(table(spark, sf, "benchmark"))
    hits = retrieval.knn_search(emb, q, 10, qid="item_id", cid="vec_id", vec="embedding", carry=["label"])
    return hits.select("item_id", F.col("rank").cast("long").alias("rank"), "vec_id", "label", "score")


@register("relevance_threshold", sql=_EMB_SCORES_SQL + """
SELECT item_id, CAST(rank AS BIGINT) AS rank, vec_id, label, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank FROM r WHERE label <= 4)
WHERE rank <= 10 AND score >= 0.25
""")
def q_relevance_threshold(spark, sf):
    """Scores of these vectors lie around 0.25, so rows fall on both sides."""
    return retrieval.relevance_threshold(q_knn_search(spark, sf), "score", 0.25)


@register("score_pairs", sql=_EMB_SCORES_SQL + """
SELECT item_id, vec_id, label, score FROM r WHERE score >= 0.25
""")
def q_score_pairs(spark, sf):
    emb = table(spark, sf, "embeddings")
    q = search.query_vectors(table(spark, sf, "benchmark"))
    return threshold.score_pairs(emb, q, 0.25, qid="item_id", cid="vec_id", vec="embedding", carry=["label"]) \
        .select("item_id", "vec_id", "label", "score")


@register("score_pair_counts", sql=_EMB_SCORES_SQL + """,
c AS (SELECT item_id, count(*) AS pairs FROM r WHERE score >= 0.25 GROUP BY item_id),
b AS (SELECT item_id, list(vec_id ORDER BY score DESC, vec_id) AS best FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank FROM r WHERE score >= 0.25)
      WHERE rank <= 5 GROUP BY item_id)
SELECT item_id, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, coalesce(best, []) AS best_vec_ids
FROM benchmark LEFT JOIN c USING (item_id) LEFT JOIN b USING (item_id)
""")
def q_score_pair_counts(spark, sf):
    """The same pairs, counted per query beside the five best of each."""
    emb = table(spark, sf, "embeddings")
    q = search.query_vectors(table(spark, sf, "benchmark"))
    found = threshold.pair_counts(emb, q, 0.25, 5, qid="item_id", cid="vec_id")
    return found.select("item_id", "pairs", F.transform("best", lambda b: b["vec_id"]).alias("best_vec_ids"))


@register("approx_knn")
def q_approx_knn(spark, sf):
    """Cells probed until the sample's recall is 0.95 (recall against the exact search is tested).
    The index is stored for the table's files; a second run of the query only searches."""
    emb = table(spark, sf, "embeddings")
    q = search.query_vectors(table(spark, sf, "benchmark"))
    path = scratch_path(spark, f"cells-{table_fingerprint(emb)}")
    return retrieval.approx_knn(emb, q, 10, qid="item_id", cid="vec_id", path=path) \
        .select("item_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


@register("hash_embed", sql=f"""
WITH qb AS (SELECT item_id, {bucket_sql('t')} AS b, count(*) AS c
            FROM (SELECT item_id, unnest({tokens_sql('text')}) AS t FROM benchmark) GROUP BY ALL),
qn AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM qb GROUP BY ALL),
grid AS (SELECT item_id, unnest(generate_series(0, 63)) AS b FROM benchmark)
SELECT g.item_id, list(round(coalesce(qb.c, 0) / qn.n, 6) ORDER BY g.b) AS embedding
FROM grid g JOIN qn USING (item_id) LEFT JOIN qb USING (item_id, b) GROUP BY g.item_id
""")
def q_hash_embed(spark, sf):
    v = search.query_vectors(table(spark, sf, "benchmark"))
    return v.select("item_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))
