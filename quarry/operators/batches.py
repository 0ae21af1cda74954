"""Arrow batches in parts of bounded size.

Spark hands Python up to 10,000 rows or 64 MB at a time.  What Python makes of
them (strings, trees, lists of rows) is several times that, and every worker of
an executor has its own; so operators take a part, hand on its rows and go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ROW_BYTES = 100  # what a row counts besides its texts


def parts(batch: pa.RecordBatch, target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``target`` bytes; a longer row stands alone."""
    n = batch.num_rows
    sizes = np.full(n, ROW_BYTES, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif n:
            sizes += column.nbytes // n
    ends = np.cumsum(sizes)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, target + (ends[i - 1] if i else 0), "right")))
        yield batch.slice(i, j - i)
        i = j


def new_columns(fields: list[T.StructField], rows: list) -> list[pa.Array]:
    """The columns of ``rows``, sequences with a value for each field."""
    values = zip(*rows, strict=True) if rows else [()] * len(fields)
    return [pa.array(v, to_arrow_type(f.dataType)) for f, v in zip(fields, values, strict=True)]
