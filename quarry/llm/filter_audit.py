"""Filter interaction audit: what each filter removes in every order of use.

A document is a mask of the filters that it fails.  Masks are counted per part
and label before anything is ordered, so the work that depends on orders is on
2**k masks and not on documents.  The step that removes a mask in an order is a
min-plus product: the mask matrix (0 where the filter fails, infinity elsewhere)
plus the matrix of positions (each order inverted: at which place a filter
stands), with the minimum over filters.  Removal steps then drive weighted
scatter counts, and what a filter fails but did not remove is redundant.

Defined results: a null text is an empty one; a null source is the part ``''``;
a document without a label is neither good nor toxic, several labels of an id
count if any of them does; a null id is larger than every other id and has no
label; repeated rows are counted each, and those that share the smallest id of
their text do not fail E; other columns are ignored, whatever their names; an
empty table has no parts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import store
from quarry.llm.quality import WHITE, let

LETTERS = "ABCDE"


def text_bits(text: Column) -> Column:
    """Bits of the filters that the text alone decides: A, B, C and D."""
    text = F.coalesce(text, F.lit(""))
    words = let(F.array_remove(F.split(text, WHITE, -1), ""), lambda w: F.struct(
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))

    def bits(w):
        failed = (w["n"] < 50, 100 * w["distinct"] < 65 * w["n"],
                  100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
                  text.rlike(r"[#$%&*|]"))
        return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failed)), F.lit(0))

    return let(words, bits)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, bits, n): documents by the filters that they fail.

    Equal texts have equal bits, so whether E fails is the only thing that
    needs other rows: one text digest and id are compared with the smallest id
    of that digest.  Both keys together, never the digest alone, deal the rows
    out, so a text on very many rows does not meet in one task."""
    rows = store(
        docs.select(F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").alias("id"),
                    F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), text_bits(F.col("text")).alias("bits"))
        .groupBy("part", "id", "digest", "bits").agg(F.count(F.lit(1)).alias("n")), "filter-bits")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marked = (rows.alias("r").join(firsts.alias("f"), (F.col("r.digest") == F.col("f.digest")) & F.col("r.id").eqNullSafe(F.col("f.id")), "left")
              .select("part", "r.id", F.when(F.col("first"), F.col("bits")).otherwise(F.col("bits") + (1 << LETTERS.index("E"))).alias("bits"), "n",
                      F.when(F.col("r.id").isNull(), F.xxhash64("r.digest")).otherwise(F.lit(0)).alias("spread")))
    flags = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
             .agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
                  F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
             .withColumn("spread", F.lit(0).cast("long")))  # rows without an id are dealt out by their texts
    return (marked.join(flags, ["id", "spread"], "left")
            .groupBy("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
            .agg(F.sum("n").alias("n")))


def removal_steps(k: int) -> tuple[np.ndarray, np.ndarray]:
    """The orders of k filters, and for each mask and order the step (from 0)
    that removes the mask; k where none does."""
    orders = np.array(list(itertools.permutations(range(k))), np.int64)
    places = np.argsort(orders, axis=1)  # inverse permutations
    fails = np.where(np.arange(1 << k)[:, None] >> np.arange(k) & 1, 0, k)
    return orders, np.minimum((fails[:, None, :] + places[None, :, :]).min(axis=2), k)


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts of
    ``failures`` (at most 4 * 2**k rows a part)."""
    k = len(letters)
    orders, steps = removal_steps(k)
    names = ["".join(letters[f] for f in order) for order in orders]
    kind = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bits, n = rows["bits"].to_numpy(), rows["n"].to_numpy(np.int64)
        lost = {}
        for name, weight in (("n", n), ("good", n * rows["good"].to_numpy()), ("toxic", n * rows["toxic"].to_numpy())):
            of_mask = np.zeros(1 << k, np.int64)
            np.add.at(of_mask, bits, weight)
            lost[name] = np.zeros((len(orders), k + 1), np.int64)
            np.add.at(lost[name], (np.arange(len(orders))[None, :], steps), of_mask[:, None])
            if name == "n":
                by_mask = of_mask
        removed = lost["n"][:, :k]
        failing = np.array([by_mask[np.arange(1 << k) >> f & 1 == 1].sum() for f in range(k)])
        shapley = np.zeros(k, np.int64)
        np.add.at(shapley, orders, removed)
        return pd.DataFrame({
            "part": rows["part"].iloc[0],
            "filter_order": np.repeat(names, k),
            "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
            "kept": (n.sum() - removed.cumsum(axis=1)).ravel(),
            "removed": removed.ravel(),
            "redundant": (failing[orders] - removed).ravel(),
            "unique_fails": by_mask[1 << orders].ravel(),
            "good_lost": lost["good"][:, :k].ravel(),
            "toxic_lost": lost["toxic"][:, :k].ravel(),
            "shapley": shapley[orders].ravel(),
        })

    return counts.groupBy("part").applyInPandas(run, kind)


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 50 THEN ['A'] ELSE [] END
        || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN ['B'] ELSE [] END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN ['C'] ELSE [] END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN ['D'] ELSE [] END
        || CASE WHEN first IS NOT NULL AND (w.doc_id IS NULL OR w.doc_id > first) THEN ['E'] ELSE [] END AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT part, filter_order, fails, n, good, toxic, list_min(list_transform(fails, lambda y: instr(filter_order, y))) AS gone FROM c, o),
p AS (SELECT part, filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM (SELECT DISTINCT part FROM c), o),
r AS (SELECT p.part, p.filter_order, p.step, filter_order[p.step] AS letter,
        sum(CASE WHEN gone IS NULL OR gone > p.step THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN gone = p.step THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN gone < p.step AND list_contains(fails, filter_order[p.step]) THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = [filter_order[p.step]] THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN gone = p.step THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN gone = p.step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM p JOIN s USING (part, filter_order) GROUP BY 1, 2, 3)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r
"""
