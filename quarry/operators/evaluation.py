"""Evaluation of answers: pairs of turns, cosine, and a judge plugin.

The judge is the caller's: a function of a list of (expected, generated) texts
that returns as many (score, feedback) pairs, scores from 0 to 10.  It runs in
Arrow batches; whatever it does to one pair, every pair keeps its row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import text as X
from quarry.functions import vectors as V

NO_ANSWER = "no generated answer"
NO_EXPECTED = "no expected answer"
LOWEST, HIGHEST = 0.0, 10.0


def turn_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               answers: str = "assistant", gap: int = 2) -> DataFrame:
    """Each answer of a conversation as ``expected``, beside the text ``gap``
    turns later as ``generated`` (null if there is none).

    The join is on (conversation, turn), so a conversation of any length is
    spread over all tasks.  Of rows with the same conversation and turn the
    smallest text counts; rows without conversation or turn pair with nothing."""
    once = turns.groupBy(conv, turn).agg(F.min(text).alias("_text"), F.max(F.col(role) == answers).alias("_answer"))
    later = once.select(F.col(conv), (F.col(turn) - gap).alias(turn), F.col("_text").alias("generated"))
    return once.where("_answer").select(conv, turn, F.col("_text").alias("expected")).join(later, [conv, turn], "left")


def cosine_scores(pairs: DataFrame, dims: int = 64, decimals: int = 6) -> DataFrame:
    """Adds ``cosine`` of the hashed vectors of both texts, computed in the
    row; null when one of them is missing or without a token."""
    columns = pairs.columns
    a = V.with_hash_embedding(pairs.withColumn("_t", X.tokens("expected")), "_t", dims, "_ve")
    b = V.with_hash_embedding(a.withColumn("_t", X.tokens("generated")), "_t", dims, "_vg")
    both = F.col("expected").isNotNull() & F.col("generated").isNotNull()
    return b.select(*columns, F.when(both, F.round(V.dot("_ve", "_vg"), decimals)).alias("cosine"))


def _verdict(answer) -> tuple[float | None, str | None, str | None]:
    """(score, feedback, error) of what a judge returned for one pair."""
    try:
        score, feedback = answer
        score = float(score)
    except (TypeError, ValueError):
        return None, None, f"no score and feedback: {answer!r}"
    if math.isnan(score) or not LOWEST <= score <= HIGHEST:
        return None, feedback, f"score outside {LOWEST:g} to {HIGHEST:g}: {score:g}"
    return score, feedback, None


def _judged(judge: Callable, texts: list[tuple[str, str]]) -> list[tuple]:
    """Verdicts of a batch; a batch that fails is asked again pair by pair."""
    try:
        answers = list(judge(texts))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} pairs")
    except Exception as e:  # noqa: BLE001 -- whatever the plugin raises is the row's error
        if len(texts) == 1:
            return [(None, None, f"{type(e).__name__}: {e}")]
        return [_judged(judge, [t])[0] for t in texts]
    return [_verdict(a) for a in answers]


def judge_answers(pairs: DataFrame, judge: Callable[[list[tuple[str, str]]], list], batch_size: int = 50) -> DataFrame:
    """Adds ``judge_score``, ``feedback`` and ``error`` to every row.

    Pairs with a missing text are not shown to the judge and say so in
    ``error``.  A batch on which the judge fails is asked again pair by pair,
    so one pair's failure is the error of its own row only."""
    columns = pairs.columns
    schema = T.StructType([*pairs.schema.fields, T.StructField("judge_score", T.DoubleType()),
                           T.StructField("feedback", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            expected, generated = pdf["expected"].tolist(), pdf["generated"].tolist()
            found = [(None, None, NO_EXPECTED if e is None else NO_ANSWER) for e in expected]
            ready = [i for i, (e, g) in enumerate(zip(expected, generated, strict=True)) if e is not None and g is not None]
            for at in range(0, len(ready), batch_size):
                part = ready[at:at + batch_size]
                for i, verdict in zip(part, _judged(judge, [(expected[i], generated[i]) for i in part]), strict=True):
                    found[i] = verdict
            for name, values in zip(("judge_score", "feedback", "error"), zip(*found, strict=True) if found else ((), (), ()), strict=True):
                pdf[name] = pd.Series(values, pdf.index, dtype=object)
            yield pdf[[*columns, "judge_score", "feedback", "error"]]

    return pairs.mapInPandas(run, schema)


def retry_list(scores: DataFrame) -> DataFrame:
    """The pairs to show to the judge again: both texts there, and an error."""
    again = F.col("error").isNotNull() & F.col("expected").isNotNull() & F.col("generated").isNotNull()
    return scores.where(again).drop("judge_score", "feedback", "error")


def merge_retries(scores: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """``scores`` with the rows of ``again`` in place of those with the same
    ``keys`` (null keys are equal).  What was judged is not judged again."""
    marks = again.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return scores.join(marks, same, "left_anti").unionByName(again)


def score_report(scores: DataFrame) -> DataFrame:
    """One row: pairs, judged, failed, unanswered, mean score and cosine of those judged."""
    judged, gone = F.col("judge_score").isNotNull(), F.col("expected").isNull() | F.col("generated").isNull()
    return scores.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(judged).alias("judged"),
                      F.count_if(~judged & ~gone).alias("failed"), F.count_if(gone).alias("unanswered"),
                      F.avg("judge_score").alias("mean_score"), F.avg(F.when(judged, F.col("cosine"))).alias("mean_cosine"))


def overlap_judge(pairs: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """An offline judge: tenths of the distinct words that both answers hold."""
    out = []
    for expected, generated in pairs:
        a, b = ({w for w in re.split(X.TOKEN_SEP, t) if w} for t in (expected, generated))
        shared, every = len(a & b), len(a | b)
        out.append((10 * shared // every if every else 0, f"{shared} of {every} words shared"))
    return out
