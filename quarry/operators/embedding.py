"""Embedding plugin stage: user-supplied batch embedder inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.operators.batches import new_columns


def embed_texts(df: DataFrame, text_col: str, id_col: str, embed_fn: Callable[[list[str]], list],
                batch_size: int = 100, model: str = "plugin", keep: tuple[str, ...] = ()) -> DataFrame:
    """Call ``embed_fn`` on batches of ``batch_size`` texts per partition; the
    rows of a batch are handed on before the next one's texts are read.

    One row per input row: id, embedding, model, tokens_used (int(words *
    1.3)), error, and the ``keep`` columns, so no join brings them back.  The
    texts of a batch that fails are tried one by one; a text that fails alone
    or is blank has a null embedding and its ``error``, ready for a retry.
    """
    columns = list(dict.fromkeys([id_col, text_col, *keep]))
    schema = T.StructType([df.schema[id_col], T.StructField("embedding", T.ArrayType(T.DoubleType())),
                           T.StructField("model", T.StringType()), T.StructField("tokens_used", T.LongType()),
                           T.StructField("error", T.StringType()), *[df.schema[c] for c in keep]])

    def embedded(texts: list[str]) -> list[tuple]:
        try:
            return [(v, None) for v in embed_fn(texts)]
        except Exception as e:  # noqa: BLE001 -- whatever the plugin raises is the row's error
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [embedded([t])[0] for t in texts]

    def handed_on(part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        filled = [i for i, t in enumerate(texts) if t and t.strip()]
        found = [(None, "empty text")] * len(texts)
        for i, hit in zip(filled, embedded([texts[i] for i in filled]) if filled else [], strict=True):
            found[i] = hit
        vectors = pa.Array.from_pandas(pd.Series([v for v, _ in found], dtype=object), type=pa.list_(pa.float64()))
        new = new_columns(schema.fields[2:5], [(model, int(len((t or "").split()) * 1.3), e) for t, (_, e) in zip(texts, found, strict=True)])
        return pa.RecordBatch.from_arrays([part.column(id_col), vectors, *new, *(part.column(c) for c in keep)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, texts, filled = 0, [], 0
            for text in batch.column(text_col):
                texts.append(text.as_py())
                filled += bool(texts[-1] and texts[-1].strip())
                if filled == batch_size:
                    yield handed_on(batch.slice(start, len(texts)), texts)
                    start, texts, filled = start + len(texts), [], 0
            if texts:
                yield handed_on(batch.slice(start, len(texts)), texts)
    return df.select(*columns).mapInArrow(run, schema)
