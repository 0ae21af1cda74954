"""Paragraph chunks with overlap and a context header.

A text is cut at three depths: paragraphs, the sentences of a paragraph that
is too large, and windows of tokens of a sentence that is.  At the first two
depths one rule decides from token counts alone which units share a chunk;
texts are joined afterwards.  Every document is independent (parts of Arrow
batches, no shuffle), and a text of any length is cut by the same rules.  The header
comes as a column (functions.text.metadata_header).

Tokens are whitespace words unless ``count`` says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.operators.batches import new_columns, parts


def count_tokens(text: str) -> int:
    return len(text.split()) if text else 0


@dataclass(frozen=True)
class ChunkSettings:
    target_tokens: int = 1000
    min_tokens: int = 500
    max_tokens: int = 1500
    overlap_tokens: int = 100
    header_overhead_tokens: int = 250
    embed_metadata: bool = True
    count: Callable[[str], int] = count_tokens

    def bounds(self) -> tuple[int, int]:
        """(most tokens of a chunk, tokens at which one is complete), less the
        room that the header takes."""
        room = self.header_overhead_tokens if self.embed_metadata else 0
        least = max(self.min_tokens - room, 50) if room else self.min_tokens
        aim = max(self.target_tokens - room, self.min_tokens // 2) if room else self.target_tokens
        return (max(self.max_tokens - room, self.min_tokens) if room else self.max_tokens), max(least, aim)


def spans(counts: list[int], most: int, complete: float, overlap: int) -> Iterator[tuple[int, int, bool | None]]:
    """Units [a, b) of each chunk and whether the end of the chunk before is
    repeated in front of them; a unit above ``most`` comes alone, with None."""
    a, size, repeats = 0, 0, False
    for k, n in enumerate(counts):
        if n > most:
            if size:
                yield a, k, repeats
            yield k, k + 1, None
            a, size, repeats = k + 1, 0, False
            continue
        closed = bool(size) and size + n > most
        if closed:
            yield a, k, repeats
            a, repeats = k, overlap > 0
            size = min(size, overlap)
        size += n
        if not closed and size >= complete and k + 1 < len(counts):
            yield a, k + 1, repeats
            a, repeats = k + 1, overlap > 0
            size = min(size, overlap)
    if size:
        yield a, len(counts), repeats


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` tokens, each starting ``overlap`` before the last
    one's end; what the last one repeats is a window of its own."""
    words = text.split()
    step = size - overlap if overlap < size else size
    last = -(-max(len(words) - size, 0) // step) * step
    starts = list(range(0, last + 1, step))
    if overlap < size and len(words) - overlap > last:
        starts.append(len(words) - overlap)
    return [" ".join(words[s:s + size]) for s in starts if s < len(words)]


def _joined(units: list[str], mark: str, most: int, complete: float, s: ChunkSettings, larger) -> list[tuple[str, int]]:
    """Chunks of units; ``larger`` cuts a unit that is too large."""
    out: list[tuple[str, int]] = []
    for a, b, repeats in spans([s.count(u) for u in units], most, complete, s.overlap_tokens):
        if repeats is None:
            out += larger(units[a])
            continue
        parts = units[a:b]
        if repeats:
            words = out[-1][0].split()
            parts = [out[-1][0] if len(words) <= s.overlap_tokens else " ".join(words[-s.overlap_tokens:]), *parts]
        body = mark.join(parts)
        out.append((body, s.count(body)))
    return out


def sentence_chunks(text: str, most: int, s: ChunkSettings) -> list[tuple[str, int]]:
    """One paragraph as chunks of whole sentences, at most ``most`` tokens."""
    cut = [x.strip() for x in re.split(r"(?<=[.!?])(?=[ \n\t])", text)]
    return _joined([x for x in cut if x] or [text], " ", most, float("inf"), s,
                   lambda x: [(w, s.count(w)) for w in windows(x, most, s.overlap_tokens)])


def pack(text: str, s: ChunkSettings) -> list[tuple[str, int]]:
    """Chunk texts with their token counts, before the header."""
    units = [p.strip() for p in (text or "").split("\n\n") if p.strip()]
    most, complete = s.bounds()
    return _joined(units, "\n\n", most, complete, s, lambda p: sentence_chunks(p, most, s))


CHUNK_SCHEMA = T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_id", T.StringType()),
                             T.StructField("text", T.StringType()), T.StructField("token_count", T.LongType())])


def paragraph_chunks(df: DataFrame, text_col: str, id_col: str, settings: ChunkSettings = ChunkSettings(),
                     header_col: str | None = None, keep: tuple[str, ...] = (),
                     long_paragraph_only: bool = False) -> DataFrame:
    """One output row per chunk: keep..., id, chunk_index, chunk_id, text
    (header + blank line + chunk when a header is given), token_count."""
    src = df.select(*keep, id_col, text_col, *([header_col] if header_col else []))
    schema = T.StructType([src.schema[c] for c in (*keep, id_col)] + CHUNK_SCHEMA.fields)

    def cut(text):
        if not long_paragraph_only:
            return pack(text, settings)
        return sentence_chunks(text, settings.max_tokens, settings) if text and text.strip() else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                texts, ids = part.column(text_col).to_pylist(), part.column(id_col).to_pylist()
                headers = part.column(header_col).to_pylist() if header_col and settings.embed_metadata else [None] * len(ids)
                rows, source = [], []
                for at, (text, own, header) in enumerate(zip(texts, ids, headers, strict=True)):
                    for k, (body, n) in enumerate(cut(text)):
                        if header:
                            body = f"{header}\n\n{body}"
                            n = settings.count(body)
                        rows.append((k, f"{own}_chunk_{k}", body, n))
                        source.append(at)
                if rows:
                    kept = [part.column(c).take(pa.array(source)) for c in (*keep, id_col)]
                    yield pa.RecordBatch.from_arrays([*kept, *new_columns(CHUNK_SCHEMA.fields, rows)], schema.names)

    return src.mapInArrow(run, schema)
