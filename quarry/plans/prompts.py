"""Prompt assembly from ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rag_prompts(queries: DataFrame, hits: DataFrame, qid: str, text_col: str, template: str,
                skip_prefix: str) -> DataFrame:
    """Per query: system message = template with the hit texts (by rank,
    blank-line separated) as context, then the user message.  Messages that
    start with ``skip_prefix`` get no system message.  Hits are already cut
    to k per query, so each group gathers at most k texts."""
    before, _, after = template.partition("{context}")
    ctx = hits.groupBy(qid).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", text_col))), lambda s: s[text_col]), "\n\n").alias("_ctx"))
    j = queries.join(ctx, qid, "left")
    system = F.when(~F.col(text_col).startswith(skip_prefix),
                    F.concat(F.lit(before), F.coalesce(F.col("_ctx"), F.lit("")), F.lit(after)))
    return j.select(qid, system.alias("system_content"), F.col(text_col).alias("user_content"),
                    F.filter(F.array(F.when(system.isNotNull(), F.struct(F.lit("system").alias("role"),
                                                                            system.alias("content"))),
                                     F.struct(F.lit("user").alias("role"), F.col(text_col).alias("content"))),
                             lambda m: m.isNotNull()).alias("messages"))
