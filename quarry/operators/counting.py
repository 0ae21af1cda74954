"""Token counts by a counter of the caller's choice."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T


def with_token_count(df: DataFrame, text_col: str, counter: re.Pattern | Callable[[list[str]], list[int]] | None = None,
                     out: str = "token_count") -> DataFrame:
    """Adds ``out``, the number of tokens of each text; null and empty texts have 0.

    ``counter``: None counts words, natively; a compiled pattern its matches,
    natively, as Java reads it; a function takes a list of texts and returns
    their counts, in Arrow batches (a tokenizer's length, for example)."""
    if counter is None:
        return df.withColumn(out, T.token_count(text_col))
    if isinstance(counter, re.Pattern):
        return df.withColumn(out, F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(counter.pattern)).cast("long"))

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        found = pd.Series(0, texts.index, dtype="int64")
        filled = texts.notna() & (texts != "")
        if filled.any():
            counts = list(counter(texts[filled].tolist()))
            if len(counts) != int(filled.sum()):
                raise ValueError(f"{len(counts)} counts of {int(filled.sum())} texts")
            found[filled] = counts
        return found

    return df.withColumn(out, counted(text_col))
