"""Typed search pre-filters applied before vector scoring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metadata_filter(df: DataFrame, date_col: str | None = None, date_gte: str | None = None,
                    date_lte: str | None = None, equals: dict | None = None) -> DataFrame:
    """AND of: day >= / <= (ISO text dates, with or without a time) and exact
    key = value matches.  ISO texts order as their dates, so the bounds compare
    the raw column -- the upper one with the day after -- and reach the scan."""
    cond = F.lit(True)
    if date_col and date_gte:
        cond = cond & (F.col(date_col) >= F.lit(date_gte))
    if date_col and date_lte:
        after = dt.date.fromisoformat(date_lte) + dt.timedelta(days=1)
        cond = cond & (F.col(date_col) < F.lit(after.isoformat()))
    for k, v in (equals or {}).items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.where(cond)
