"""Threshold joins: (query, corpus row) pairs whose cosine reaches a bound.

A pair is scored in full only if an upper bound of its cosine reaches the
threshold.  The bound comes from the leading coordinates of both vectors after
a rotation that gathers the block of queries into them (the eigenvectors of
its scatter matrix; a rotation changes no cosine): their product, plus the
product of the norms of what is left (Cauchy-Schwarz).  Over a stored
``CellIndex`` whole cells go first, and the scan skips their row groups.

Queries come in broadcast blocks of bounded size, the corpus is never moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.retrieval import (DEFAULT_MAX_BLOCK_BYTES, MAX_SCORES, SCORE_DECIMALS, CellIndex, _unit_rows, in_blocks,
                                        top_k_per_group)

#: Scores are compared after rounding, so a bound may fall short by half a unit and the error of the products.
SLACK = 10.0 ** -SCORE_DECIMALS
#: Share of the queries' squared length that the leading coordinates should hold.
HEAD_SHARE = 0.9


class PrefixBound:
    """Unit query rows with their rotation, and the pairs they form."""

    def __init__(self, unit: np.ndarray, min_score: float):
        self.unit, self.min_score = unit, min_score
        dims = unit.shape[1] if len(unit) else 0
        share, axes = np.linalg.eigh(unit.T @ unit) if dims else (np.zeros(0), np.zeros((0, 0)))
        held = np.cumsum(share[::-1]) / max(share.sum(), 1e-300)
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, :min(max(1, dims // 2), int(np.searchsorted(held, HEAD_SHARE)) + 1)])
        self.head, self.rest = self._split(unit)

    def _split(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norms of what is left."""
        head = unit @ self.axes
        return head, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", head, head)) + 1e-12)

    def pairs(self, who: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query place, row place, score) of the pairs that reach the
        threshold, and how many pairs of each query of ``who`` were scored;
        in pieces of at most ``MAX_SCORES`` bounds."""
        head, rest = self._split(unit)
        step = max(1, MAX_SCORES // max(1, len(unit)))
        for at in range(0, len(who) if len(unit) else 0, step):
            part = who[at:at + step]
            bound = self.head[part] @ head.T + self.rest[part, None] * rest[None, :]
            alive = bound >= self.min_score - SLACK
            scored = np.zeros(len(who), np.int64)
            scored[at:at + step] = alive.sum(axis=1)
            if 2 * scored.sum() > alive.size:  # most are left: one dense product
                scored[at:at + step] = len(unit)
                s = self.unit[part] @ unit.T
                qi, ri = np.nonzero(np.round(s, SCORE_DECIMALS) >= self.min_score)
                yield part[qi], ri, s[qi, ri], scored
                continue
            qi, ri = np.nonzero(alive)
            s = np.empty(len(qi))
            width = max(1, MAX_SCORES // max(1, unit.shape[1]))
            for lo in range(0, len(qi), width):
                few = slice(lo, lo + width)
                s[few] = np.einsum("ij,ij->i", self.unit[part[qi[few]]], unit[ri[few]])
            good = np.round(s, SCORE_DECIMALS) >= self.min_score
            yield part[qi[good]], ri[good], s[good], scored


def _scan(corpus: DataFrame, block: pd.DataFrame, qid: str, cid: str, vec: str, carry: list[str], schema: T.StructType,
          min_score: float, k: int | None, wanted: Callable | None):
    """Pairs of a block of queries; with ``k`` the k best per query of each
    batch, and per task one row of counts for each query."""
    ok, unit_queries = _unit_rows(block[vec])
    ids = block[qid].to_numpy()[ok]
    cells = None if wanted is None else wanted(unit_queries)
    if cells is not None:
        corpus = corpus.where(F.col("_cell").isin([int(c) for c in np.nonzero(cells.any(axis=0))[0]]))
    shared = corpus.sparkSession.sparkContext.broadcast((ids, PrefixBound(unit_queries, min_score), cells))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, bound, cells = shared.value
        pairs, scored = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for pdf in batches:
            if len(pdf) == 0 or len(ids) == 0:
                continue
            good, unit = _unit_rows(pdf[vec], bound.unit.shape[1])
            pdf = pdf[good]
            parts = [(pdf, unit, np.arange(len(ids)))]
            if cells is not None:
                of_row = pdf["_cell"].to_numpy()
                parts = [(pdf[of_row == c], unit[of_row == c], np.nonzero(cells[:, c])[0]) for c in np.unique(of_row)]
            for part, part_unit, who in parts:
                for qi, ri, s, done in bound.pairs(who, part_unit):
                    pairs += np.bincount(qi, minlength=len(ids))
                    scored[who] += done
                    if k is not None:
                        qi, ri, s = _k_best(qi, ri, s, part[cid].to_numpy(), k)
                    out = {"_qid": ids[qi], "_cid": part[cid].to_numpy()[ri], "_score": s}
                    out.update({c: part[c].to_numpy()[ri] for c in carry})
                    if k is not None:
                        out.update({"pairs": 0, "scored": 0})
                    if len(qi):
                        yield pd.DataFrame(out)
        if k is not None and scored.any():
            some = scored > 0
            yield pd.DataFrame({"_qid": ids[some], "_cid": pd.Series([None] * int(some.sum()), dtype=object), "_score": None,
                                "pairs": pairs[some], "scored": scored[some]})

    extra = [] if cells is None else ["_cell"]
    return corpus.select(cid, vec, *carry, *extra).mapInPandas(rows, schema), shared


def _k_best(qi: np.ndarray, ri: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int):
    """The k best of each query's pairs, equal scores by id."""
    order = pd.DataFrame({"q": qi, "s": -np.round(s, SCORE_DECIMALS), "id": ids[ri]}).sort_values(["q", "s", "id"], kind="stable")
    keep = order.index[order.groupby("q").cumcount().to_numpy() < k]
    return qi[keep], ri[keep], s[keep]


def score_pairs(corpus: DataFrame | CellIndex, queries: DataFrame, min_score: float, *, qid: str = "qid",
                cid: str = "chunk_id", vec: str = "embedding", query_vec: str | None = None,
                carry: list[str] | None = None, max_block_bytes: int = DEFAULT_MAX_BLOCK_BYTES) -> DataFrame:
    """Every (query, corpus row) pair whose cosine, rounded to 6, is >= ``min_score``:
    qid, cid, carry..., score.  Nothing is shuffled.  Null and zero vectors and
    those of another length than the queries' pair with nothing.

    The output grows with the pairs; ``pair_counts`` bounds it.  With a
    ``CellIndex`` as corpus (its own id and vector columns are used) only the
    cells are read that can hold such a pair."""
    rows, cid, vec, wanted, query_vec = _source(corpus, cid, vec, query_vec, min_score)
    carry = list(carry or [])
    schema = T.StructType([T.StructField("_qid", queries.schema[qid].dataType), T.StructField("_cid", rows.schema[cid].dataType),
                           T.StructField("_score", T.DoubleType()), *[T.StructField(c, rows.schema[c].dataType) for c in carry]])
    found = in_blocks(rows, queries, qid, cid, vec, query_vec, carry, max_block_bytes,
                      lambda r, block: _scan(r, block, qid, cid, vec, carry, schema, min_score, None, wanted), lambda h: h, wanted is not None)
    return found.select(F.col("_qid").alias(qid), F.col("_cid").alias(cid), *carry, F.round("_score", SCORE_DECIMALS).alias("score"))


def pair_counts(corpus: DataFrame | CellIndex, queries: DataFrame, min_score: float, k: int, *, qid: str = "qid",
                cid: str = "chunk_id", vec: str = "embedding", query_vec: str | None = None,
                max_block_bytes: int = DEFAULT_MAX_BLOCK_BYTES) -> DataFrame:
    """Per query: how many corpus rows reach ``min_score`` (``pairs``, all of
    them), how many were scored in full to find that (``scored``), and the k
    best as ``best`` (array of cid, score; equal scores by id).

    One row per row of ``queries``, also for those that reach nothing; ids are
    unique.  The result has at most k entries a query however many pairs there are."""
    rows, cid, vec, wanted, query_vec = _source(corpus, cid, vec, query_vec, min_score)
    schema = T.StructType([T.StructField("_qid", queries.schema[qid].dataType), T.StructField("_cid", rows.schema[cid].dataType),
                           T.StructField("_score", T.DoubleType()), T.StructField("pairs", T.LongType()),
                           T.StructField("scored", T.LongType())])
    found = in_blocks(rows, queries, qid, cid, vec, query_vec, [], max_block_bytes,
                      lambda r, block: _scan(r, block, qid, cid, vec, [], schema, min_score, k, wanted), lambda h: h, wanted is not None)
    hit = F.col("_score").isNotNull()
    rounded = found.withColumn("_score", F.round("_score", SCORE_DECIMALS))
    best = top_k_per_group(rounded.where(hit), ["_qid"], [F.col("_score").desc(), F.col("_cid").asc()], k)
    best = best.select("_qid", F.lit(0).cast("long").alias("pairs"), F.lit(0).cast("long").alias("scored"),
                       F.struct("rank", F.struct(F.col("_cid").alias(cid), F.col("_score").alias("score")).alias("hit")).alias("_hit"))
    counts = found.where(~hit).select("_qid", "pairs", "scored", F.lit(None).cast(best.schema["_hit"].dataType).alias("_hit"))
    per_query = counts.unionByName(best).groupBy("_qid").agg(
        F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored"),
        F.transform(F.array_sort(F.collect_list("_hit")), lambda h: h["hit"]).alias("best"))  # k at most
    asked = queries.select(qid)
    none = F.array().cast(per_query.schema["best"].dataType)
    return asked.join(per_query, asked[qid].eqNullSafe(per_query["_qid"]), "left").select(
        asked[qid], F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("scored", F.lit(0)).alias("scored"),
        F.coalesce("best", none).alias("best"))


def _source(corpus: DataFrame | CellIndex, cid: str, vec: str, query_vec: str | None, min_score: float):
    """Rows, their id and vector columns, which cells are wanted, and the queries' vector column."""
    if not isinstance(corpus, CellIndex):
        return corpus, cid, vec, None, query_vec
    if not len(corpus.centres):
        return corpus.rows, corpus.cid, corpus.vec, None, query_vec or vec

    def wanted(unit: np.ndarray) -> np.ndarray:
        if not len(unit):
            return np.zeros((0, len(corpus.centres)), dtype=bool)
        return (corpus.bounds(unit @ corpus.centres.T)[0] >= min_score - SLACK) & (corpus.sizes > 0)

    return corpus.rows, corpus.cid, corpus.vec, wanted, query_vec or vec
