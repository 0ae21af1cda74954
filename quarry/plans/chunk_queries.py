"""Registered chunking queries (rows 87-90 of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import chunking
from quarry.plans.registry import register
from quarry.plans.sql_fragments import tokens_sql
from quarry.sources.tables import table


@register("fixed_token_chunks", sql=f"""
WITH d AS (SELECT doc_id, {tokens_sql('text')} AS tok FROM documents),
w AS (SELECT doc_id, s, list_slice(tok, s + 1, s + 400) AS ctok
      FROM (SELECT doc_id, tok, unnest(generate_series(0, CAST(ceil(greatest(len(tok) - 400, 0) / 350.0) * 350 AS BIGINT), 350)) AS s
            FROM d WHERE len(tok) > 0))
SELECT doc_id, CAST(s // 350 AS INTEGER) AS chunk_index, CAST(doc_id AS VARCHAR) || '_chunk_' || CAST(s // 350 AS VARCHAR) AS chunk_id,
       array_to_string(ctok, ' ') AS text, CAST(len(ctok) AS BIGINT) AS token_count
FROM w
""")
def q_fixed_token_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.fixed_token_chunks(d, "text", "doc_id", 400, 50).drop("chunk_tokens")


@register("token_window_chunks", sql=f"""
WITH d AS (SELECT doc_id, {tokens_sql('text')} AS tok FROM documents),
l AS (SELECT doc_id, tok, len(tok) AS n, CAST(ceil(greatest(len(tok) - 100, 0) / 80.0) * 80 AS BIGINT) AS last FROM d WHERE len(tok) > 0),
st AS (SELECT doc_id, tok, list_concat(generate_series(0, last, 80), CASE WHEN n - 20 > last THEN [n - 20] ELSE [] END) AS starts FROM l),
w AS (SELECT doc_id, tok, unnest(starts) AS s, unnest(generate_series(0, len(starts) - 1)) AS pos FROM st)
SELECT doc_id, CAST(pos AS INTEGER) AS chunk_index, CAST(doc_id AS VARCHAR) || '_chunk_' || CAST(pos AS VARCHAR) AS chunk_id,
       array_to_string(list_slice(tok, s + 1, s + 100), ' ') AS text, CAST(len(list_slice(tok, s + 1, s + 100)) AS BIGINT) AS token_count
FROM w
""")
def q_token_window_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.token_window_chunks(d, "text", "doc_id", max_tokens=100, overlap=20)


def _chunk_input(spark, sf):
    """Decisions with paragraphs (newline -> blank line) and their header."""
    from quarry.functions import text as T
    from quarry.operators.partitioning import fan_out
    from quarry.sources.decisions import decisions_from_documents
    d = decisions_from_documents(fan_out(table(spark, sf, "documents"), "doc_id"))
    return d.select("NativeId", F.regexp_replace("Content", "\n", "\n\n").alias("text"),
                    T.metadata_header("Title", "NativeId", "ClassificationTitle", "ClassificationCode",
                                      "OrganizationName", "DateDecision", "CaseID", "Section").alias("header"))


@register("paragraph_chunks")
def q_paragraph_chunks(spark, sf):
    """Greedy paragraph packing 100/50/150, overlap 20, header 75 (rows-only
    check; semantics pinned by golden tests)."""
    from quarry.operators.paragraph_chunker import ChunkSettings, paragraph_chunks
    s = ChunkSettings(target_tokens=100, min_tokens=50, max_tokens=150, overlap_tokens=20, header_overhead_tokens=75)
    return paragraph_chunks(_chunk_input(spark, sf), "text", "NativeId", s, header_col="header")


@register("long_paragraph_chunks")
def q_long_paragraph_chunks(spark, sf):
    """Whole document as one paragraph: sentence packing, oversize sentences
    to token windows (rows-only check)."""
    from quarry.operators.paragraph_chunker import ChunkSettings, paragraph_chunks
    s = ChunkSettings(max_tokens=120, overlap_tokens=20, embed_metadata=False)
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("NativeId"), "text")
    return paragraph_chunks(d, "text", "NativeId", s, long_paragraph_only=True)
