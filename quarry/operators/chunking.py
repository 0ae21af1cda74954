"""Chunking operators that stay native: token windows and fixed splitters.

Each takes a DataFrame and returns one row per chunk; the work is row-local
(``posexplode`` of a computed array), so no shuffle is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T



def window_starts(n: Column, max_tokens: int, overlap: int, tail: bool) -> Column:
    """Start offsets of the sliding token windows over ``n`` tokens.

    Windows of ``max_tokens`` with step ``max_tokens - overlap`` until one
    reaches the end.  With ``tail`` (the long-sentence splitter) the last
    ``overlap`` tokens are emitted once more after the window that reached
    the end.  When overlap >= max the step is max and there is no tail.
    """
    if overlap >= max_tokens:
        step, ov = max_tokens, 0
    else:
        step, ov = max_tokens - overlap, overlap
    last = (F.ceil(F.greatest(n - max_tokens, F.lit(0)) / step) * step).cast("int")
    starts = F.sequence(F.lit(0), last, F.lit(step))
    if tail and ov > 0:
        tail_start = n - ov
        starts = F.when(tail_start > last, F.concat(starts, F.array(tail_start.cast("int")))) \
                  .otherwise(starts)
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def fixed_token_chunks(df: DataFrame, text_col: str, id_col: str, size: int = 400,
                       overlap: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chat-tier splitter: windows of ``size`` whitespace tokens, ``overlap``
    shared, no extra tail.  Output: keep..., id, chunk_index, chunk_id,
    chunk_tokens (array), text, token_count."""
    staged = df.select(*keep, id_col, T.tokens(text_col).alias("_tok"))
    tok = F.col("_tok")
    starts = window_starts(F.size(tok), size, overlap, tail=False)
    windows = F.transform(starts, lambda s: F.slice(tok, s + 1, size))
    out = staged.select(*keep, id_col, F.posexplode(windows).alias("chunk_index", "chunk_tokens"))
    return out.select(*keep, id_col, "chunk_index",
                      T.chunk_id(id_col, "chunk_index").alias("chunk_id"),
                      "chunk_tokens",
                      F.array_join("chunk_tokens", " ").alias("text"),
                      F.size("chunk_tokens").cast("long").alias("token_count"))


def token_window_chunks(df: DataFrame, text_col: str, id_col: str, max_tokens: int = 1500,
                        overlap: int = 100, start_index: int = 0,
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """Token splitter of the long-paragraph path: windows of ``max_tokens``
    with ``overlap``; the overlap tail is emitted again.  No chunk cap by
    default (whole texts); there is no cap."""
    staged = df.select(*keep, id_col, T.tokens(text_col).alias("_tok"))
    tok = F.col("_tok")
    starts = window_starts(F.size(tok), max_tokens, overlap, tail=True)
    windows = F.transform(starts, lambda s: F.slice(tok, s + 1, max_tokens))
    out = staged.select(*keep, id_col, F.posexplode(windows).alias("pos", "chunk_tokens"))
    idx = (F.col("pos") + F.lit(start_index)).cast("int")
    return out.select(*keep, id_col, idx.alias("chunk_index"),
                      T.chunk_id(id_col, idx).alias("chunk_id"),
                      F.array_join("chunk_tokens", " ").alias("text"),
                      F.size("chunk_tokens").cast("long").alias("token_count"))
