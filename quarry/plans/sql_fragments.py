"""Reusable DuckDB SQL pieces for the oracle statements."""

# whitespace tokens of a text column (same separators as functions.text.TOKEN_SEP)
def tokens_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({col}, ''), '[\\t\\n\\x0B\\f\\r ]+'), lambda x: x <> '')"


def bucket_sql(tok: str, dims: int = 64) -> str:
    return f"(('0x' || substr(md5({tok}), 1, 8))::BIGINT % {dims})"


# chunk windows of 400 tokens, step 350, one row per (doc_id, chunk_index, token)
CHUNK_TOKENS_CTE = f"""
d AS (
  SELECT doc_id, {tokens_sql('text')} AS tok
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''
),
w AS (
  SELECT doc_id, s // 350 AS idx, list_slice(tok, s + 1, s + 400) AS ctok
  FROM (SELECT doc_id, tok,
               unnest(generate_series(0, CAST(ceil(greatest(len(tok) - 400, 0) / 350.0) * 350 AS BIGINT), 350)) AS s
        FROM d WHERE len(tok) > 0)
),
cb AS (
  SELECT doc_id, idx, {bucket_sql('t')} AS b, count(*) AS c
  FROM (SELECT doc_id, idx, unnest(ctok) AS t FROM w) GROUP BY ALL
),
cn AS (SELECT doc_id, idx, sqrt(sum(c * c)) AS n FROM cb GROUP BY ALL)
"""

QUERY_BUCKETS_CTE = f"""
qb AS (
  SELECT item_id, {bucket_sql('t')} AS b, count(*) AS c
  FROM (SELECT item_id, unnest({tokens_sql('text')}) AS t FROM benchmark) GROUP BY ALL
),
qn AS (SELECT item_id, sqrt(sum(c * c)) AS n FROM qb GROUP BY ALL)
"""
