"""Vector retrieval: exact and approximate cosine top-k, per-group top-k.

The query side is cut into blocks of at most ``max_block_bytes``.  One block
at a time is broadcast; every corpus partition scores its rows against it
with NumPy products of bounded size and emits only its best rows per query
(ties at the k-th score included, so an exact search stays exact).  With
several blocks, each block's candidates are written to the shared folder
and its broadcast is destroyed before the next block is read, so the driver
holds one block, whatever the number of queries.  Only candidates are
shuffled, by query id, to the final ranking (``row_number`` with
WindowGroupLimit); corpus rows stay where they are and no pair table exists.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.relational import with_global_index
from quarry.session import scratch_path, shared_table
from quarry.sources.manifest import Manifests

SCORE_DECIMALS = 6
DEFAULT_MAX_BLOCK_BYTES = 64 * 1024 * 1024
#: Scores held at once by one task (32 MiB of doubles).
MAX_SCORES = 1 << 22


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Best ``k`` rows per group by ``order_cols`` (Catalyst plans a
    WindowGroupLimit below the window, so each task keeps only k per group
    before the rank is finalised)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def relevance_threshold(df: DataFrame, score_col: str = "score", threshold: float = 0.51) -> DataFrame:
    return df.where(F.col(score_col) >= threshold)


def _unit_rows(vectors: pd.Series, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be scored (present, of ``dims`` numbers, not zero),
    and those as unit rows."""
    ok = vectors.map(lambda v: v is not None and (dims is None or len(v) == dims)).to_numpy(dtype=bool)
    if not ok.any():
        return ok, np.zeros((0, dims or 0))
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors[ok]])
    norm = np.linalg.norm(m, axis=1)
    ok[ok] = norm > 0
    return ok, m[norm > 0] / norm[norm > 0, None]


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places of the k best scores per query, ties included."""
    n = scores.shape[1]
    if n <= k:
        return np.nonzero(np.ones_like(scores, dtype=bool))
    kth = np.partition(scores, n - k, axis=1)[:, n - k]
    return np.nonzero(scores >= kth[:, None])


def _score(corpus: DataFrame, block: pd.DataFrame, qid: str, cid: str, vec: str, carry: list[str],
           schema: T.StructType, pick: Callable, wanted: Callable | None = None):
    """Rows of ``corpus`` that ``pick`` takes for the queries of a block.

    ``wanted(unit query rows)`` may name the cells each query looks into (a
    boolean matrix); then only rows whose ``_cell`` is among them are scored.
    Returns the hits and the broadcast to destroy.
    """
    ok, mat = _unit_rows(block[vec])
    ids = block[qid].to_numpy()[ok]
    cells = None if wanted is None else wanted(mat)
    if cells is not None:  # reaches the scan: files and row groups are sorted by cell
        corpus = corpus.where(F.col("_cell").isin([int(c) for c in np.nonzero(cells.any(axis=0))[0]]))
    shared = corpus.sparkSession.sparkContext.broadcast((ids, mat, cells))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mat, cells = shared.value
        for pdf in batches:
            if len(pdf) == 0 or len(ids) == 0:
                continue
            good, unit = _unit_rows(pdf[vec], mat.shape[1])
            pdf = pdf[good]
            parts = [(pdf, unit, np.arange(len(ids)))]
            if cells is not None:
                of_row = pdf["_cell"].to_numpy()
                parts = [(pdf[of_row == c], unit[of_row == c], np.nonzero(cells[:, c])[0]) for c in np.unique(of_row)]
            for part, unit, who in parts:
                step = max(1, MAX_SCORES // max(1, len(part)))
                for at in range(0, len(who) if len(part) else 0, step):
                    s = mat[who[at:at + step]] @ unit.T
                    qi, ri = pick(np.round(s, SCORE_DECIMALS))
                    out = {"_qid": ids[who[at + qi]], "_cid": part[cid].to_numpy()[ri], "_score": s[qi, ri]}
                    out.update({c: part[c].to_numpy()[ri] for c in carry})
                    yield pd.DataFrame(out)

    extra = [] if cells is None else ["_cell"]
    return corpus.select(cid, vec, *carry, *extra).mapInPandas(rows, schema), shared


def _hits(corpus: DataFrame, queries: DataFrame, qid: str, cid: str, vec: str, query_vec: str | None,
          carry: list[str], max_block_bytes: int, pick: Callable, cut: Callable,
          wanted: Callable | None = None) -> DataFrame:
    """Scored rows of all queries; ``cut`` shrinks what a block stores."""
    schema = T.StructType([T.StructField("_qid", queries.schema[qid].dataType),
                           T.StructField("_cid", corpus.schema[cid].dataType),
                           T.StructField("_score", T.DoubleType()),
                           *[T.StructField(c, corpus.schema[c].dataType) for c in carry]])
    return in_blocks(corpus, queries, qid, cid, vec, query_vec, carry, max_block_bytes,
                     lambda rows, block: _score(rows, block, qid, cid, vec, carry, schema, pick, wanted), cut, wanted is not None)


def in_blocks(corpus: DataFrame, queries: DataFrame, qid: str, cid: str, vec: str, query_vec: str | None,
              carry: list[str], max_block_bytes: int, score: Callable, cut: Callable, stored: bool = False) -> DataFrame:
    """What ``score(corpus, block of queries)`` finds for all blocks; it returns
    the rows and the broadcast to destroy.  ``stored``: the corpus is a table."""
    queries = queries.select(F.col(qid), F.col(query_vec or vec).alias(vec))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vec)), F.lit(0)).alias("d")).first()
    per_block = max(1, max_block_bytes // (max(size["d"], 1) * 8 + 64))
    if size["n"] <= per_block:
        return score(corpus, queries.toPandas())[0]
    numbered = shared_table(with_global_index(queries, [qid], "_at").withColumn(
        "_block", F.floor(F.col("_at") / per_block).cast("long")).drop("_at"), "query-blocks", "_block")
    if not stored:  # scanned once per block: what computed the corpus runs once
        corpus = shared_table(corpus.select(cid, vec, *carry), "corpus")
    found = None
    for b in range(-(-size["n"] // per_block)):
        block = numbered.where(F.col("_block") == b).drop("_block").toPandas()  # per_block rows at most
        hits, shared = score(corpus, block)
        part = shared_table(cut(hits), "block-hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def _ranked(corpus, queries, k, qid, cid, vec, query_vec, carry, max_block_bytes, wanted=None) -> DataFrame:
    def cut(hits):
        hits = hits.withColumn("_score", F.round("_score", SCORE_DECIMALS))
        return top_k_per_group(hits, ["_qid"], [F.col("_score").desc(), F.col("_cid").asc()], k)

    found = _hits(corpus, queries, qid, cid, vec, query_vec, carry, max_block_bytes,
                  lambda s: _best(s, k), lambda h: cut(h).drop("rank"), wanted)
    return cut(found).select(F.col("_qid").alias(qid), F.col("_cid").alias(cid), *carry,
                             F.col("_score").alias("score"), "rank")


def knn_search(corpus: DataFrame, queries: DataFrame, k: int = 10, *, qid: str = "qid",
               cid: str = "chunk_id", vec: str = "embedding", query_vec: str | None = None,
               carry: list[str] | None = None,
               max_block_bytes: int = DEFAULT_MAX_BLOCK_BYTES) -> DataFrame:
    """Exact cosine top-k of every query over the corpus.

    Output: qid, cid, carry..., score (rounded to 6), rank (1..k); order by
    score desc then corpus id.  Zero-norm vectors never match.
    """
    return _ranked(corpus, queries, k, qid, cid, vec, query_vec, list(carry or []), max_block_bytes)


class CellIndex:
    """Approximate top-k: unit vectors in cells around spherical k-means centres,
    stored so that later searches, in other sessions too, fit nothing.

    ``build`` fits the centres (``n_cells``, by default the square root of the
    row count, at most 4,096) on about ``sample_rows`` rows, those whose id has
    a hash below that share, assigns every row to its nearest centre and writes
    the rows sorted by cell.  ``add`` assigns further rows to the same centres
    and touches no stored file.  A query looks into its nearest cells only, and
    the scan skips the row groups of the others.

    How many cells: the fewest with which ``recall`` of the exact k nearest
    sample rows are found for 256 queries of the block; and always enough to
    hold k rows.  Of these the cells go that cannot hold one of the k best: a
    cell knows the widest angle between its centre and a row, so by the triangle
    inequality it bounds the scores in it from both sides.  With ``recall`` 1
    only that bound decides, and the search is exact."""

    def __init__(self, spark: SparkSession, path: str):
        """The index stored at ``path``."""
        self.path, self.manifests = path, Manifests(spark, path)
        m = self.manifest = self.manifests.load()
        if m is None:
            raise FileNotFoundError(f"no index at {path}")
        self.cid, self.vec, self.keep = m["cid"], m["vec"], m["keep"]
        fitted = spark.read.parquet(self.manifests.folder(m["fitted"])).toPandas()
        stacked = {kind: np.array(rows["v"].tolist(), dtype=float).reshape(len(rows), -1)
                   for kind, rows in fitted.sort_values("n").groupby("kind")}
        self.centres = stacked.get("centre", np.zeros((0, 0)))
        self.sample = stacked.get("sample", np.zeros((0, 0)))
        self.sizes, self.nearest = np.array(m["sizes"], np.int64), np.array(m["nearest"], float)
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        parts = [spark.read.schema(schema).parquet(self.manifests.folder(c)) for c in m["commits"]]
        self.rows = functools.reduce(DataFrame.unionByName, parts)

    @classmethod
    def build(cls, corpus: DataFrame, path: str, *, cid: str = "chunk_id", vec: str = "embedding", keep: tuple[str, ...] = (),
              n_cells: int | None = None, sample_rows: int = 20_000, seed: int = 7) -> "CellIndex":
        spark, manifests = corpus.sparkSession, Manifests(corpus.sparkSession, path)
        manifests.check_free()
        n = corpus.count()
        _, sample = _unit_rows(_id_share(corpus.select(cid, vec), cid, sample_rows, n).toPandas()[vec])
        if not len(sample):
            _, sample = _unit_rows(corpus.where(F.col(vec).isNotNull()).select(vec).limit(sample_rows).toPandas()[vec])
        wanted = n_cells or min(4096, max(1, round(n ** 0.5)))
        centres = _centres(sample, min(wanted, len(sample)), seed)
        fitted = manifests.new_folder()
        rows = [("centre", k, v.tolist()) for k, v in enumerate(centres)] + [("sample", k, v.tolist()) for k, v in enumerate(sample)]
        spark.createDataFrame(rows, "kind string, n int, v array<double>").write.parquet(manifests.folder(fitted))
        base = {"version": 0, "cid": cid, "vec": vec, "keep": list(keep), "fitted": fitted, "commits": [],
                "sizes": [0] * len(centres), "nearest": [1.0] * len(centres)}
        _add_to_cells(manifests, base, corpus, centres)
        return cls(spark, path)

    def add(self, rows: DataFrame) -> "CellIndex":
        """The index with further rows; the caller sees to it that their ids are new."""
        _add_to_cells(self.manifests, self.manifest, rows, self.centres)
        return CellIndex(rows.sparkSession, self.path)

    def _probes(self, unit: np.ndarray, k: int, recall: float) -> int:
        """The fewest nearest cells with which the sample's recall is reached."""
        unit = unit[:256]
        top = np.argsort(-(unit @ self.sample.T), axis=1)[:, :k]
        cell = (self.sample @ self.centres.T).argmax(axis=1)
        place = np.argsort(np.argsort(-(unit @ self.centres.T), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(place, cell[top], axis=1).ravel()) + 1
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1

    def bounds(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest and lowest score that a row of each cell can have, by the
        cosines of the queries to the centres."""
        angle, radius = np.arccos(np.clip(near, -1, 1)), np.arccos(np.clip(self.nearest, -1, 1))
        return np.cos(np.maximum(angle - radius, 0)), np.cos(np.minimum(angle + radius, np.pi))

    def cells(self, unit: np.ndarray, k: int, recall: float) -> np.ndarray:
        """Which cells each query looks into."""
        if not len(unit):
            return np.zeros((0, len(self.centres)), dtype=bool)
        near = unit @ self.centres.T
        order = np.argsort(-near, axis=1)
        before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        probes = len(self.centres) if recall >= 1 else self._probes(unit, k, recall)
        cells = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(cells, order, (np.arange(order.shape[1])[None, :] < probes) | (before < k), axis=1)
        best, worst = self.bounds(near)
        falling = np.argsort(-worst, axis=1)
        held = np.cumsum(self.sizes[falling], axis=1)
        kth = np.argmax(held >= k, axis=1)  # from so many cells k rows score at least this
        least = np.take_along_axis(np.take_along_axis(worst, falling, axis=1), kth[:, None], axis=1)
        least = np.where(held[:, -1:] >= k, least, -1.0)
        return cells & (best >= least - 10.0 ** -SCORE_DECIMALS) & (self.sizes > 0)

    def search(self, queries: DataFrame, k: int = 10, *, qid: str = "qid", query_vec: str | None = None,
               recall: float = 0.95, max_block_bytes: int = DEFAULT_MAX_BLOCK_BYTES) -> DataFrame:
        """Output as ``knn_search``; k rows per query if the index has as many."""
        wanted = (lambda unit: self.cells(unit, k, recall)) if len(self.centres) else None
        return _ranked(self.rows, queries, k, qid, self.cid, self.vec, query_vec, self.keep, max_block_bytes, wanted)


def _add_to_cells(manifests: Manifests, base: dict, rows: DataFrame, centres: np.ndarray) -> None:
    """Write ``rows`` with the cell of their nearest centre and their cosine to
    it, sorted by cell, and commit them with the sizes and widths of cells."""
    cid, vec = base["cid"], base["vec"]
    schema = T.StructType([rows.schema[cid], rows.schema[vec], *[rows.schema[c] for c in base["keep"]],
                           T.StructField("_cell", T.IntegerType()), T.StructField("_near", T.DoubleType())])

    def assign(batches):
        for pdf in batches:
            ok, unit = _unit_rows(pdf[vec], centres.shape[1])
            if ok.any():
                near = unit @ centres.T
                yield pdf[ok].assign(_cell=near.argmax(axis=1).astype(np.int32), _near=near.max(axis=1))

    commit = manifests.new_folder()
    placed = rows.select(cid, vec, *base["keep"]).mapInPandas(assign, schema)
    placed.repartitionByRange("_cell", cid).sortWithinPartitions("_cell").write.parquet(manifests.folder(commit))
    sizes, nearest = list(base["sizes"]), list(base["nearest"])
    stored = rows.sparkSession.read.schema(schema).parquet(manifests.folder(commit))
    for r in stored.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_near").alias("near")).collect():  # one row per cell
        sizes[r["_cell"]] += r["n"]
        nearest[r["_cell"]] = min(nearest[r["_cell"]], r["near"])
    manifests.commit(base["version"], base | {"commits": base["commits"] + [commit], "sizes": sizes, "nearest": nearest, "schema": schema.json()})


def _id_share(df: DataFrame, cid: str, rows: int, n: int) -> DataFrame:
    """About ``rows`` of ``n`` rows, by the hash of the id (never more than twice)."""
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(cid), F.lit(1 << 30)) < (rows << 30) // n).limit(2 * rows)


def _centres(unit: np.ndarray, n_cells: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of the sample."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), n_cells, replace=False)] if n_cells else unit
    for _ in range(rounds if n_cells else 0):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centres)
    return centres


def approx_knn(corpus: DataFrame, queries: DataFrame, k: int, *, qid: str = "qid", cid: str = "chunk_id",
               vec: str = "embedding", recall: float = 0.95, n_cells: int | None = None, path: str | None = None) -> DataFrame:
    """Approximate top-k by the ``CellIndex`` at ``path``, which is built there
    from ``corpus`` if there is none; without ``path`` for this one search."""
    spark = corpus.sparkSession
    path = path or scratch_path(spark, f"cells-{uuid.uuid4().hex[:12]}")
    stored = Manifests(spark, path).load() is not None
    index = CellIndex(spark, path) if stored else CellIndex.build(corpus, path, cid=cid, vec=vec, n_cells=n_cells)
    return index.search(queries, k, qid=qid, recall=recall)
