"""Answer pairs, cosine and the judge plugin: failures, retries, hot conversations."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation as E

TURNS = "conv_id long, turn long, role string, text string, judge_score string"


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TURNS)


def test_every_answer_is_paired(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"a{t}") for t in range(400)] + [
        (2, 1, "assistant", "x"), (2, 3, "assistant", None), (3, 1, "assistant", "y"), (3, 1, "assistant", "b"),
        (3, 3, "user", "u"), (None, 1, "assistant", "n"), (None, 3, "assistant", "n3"), (4, 2, "user", "q"), (5, 1, None, "r")]
    got = {(r["conv_id"], r["turn"]): (r["expected"], r["generated"]) for r in E.turn_pairs(_turns(spark, rows)).collect()}
    want = {(1, t): (f"a{t}", f"a{t + 2}" if t + 2 < 400 else None) for t in range(1, 400, 2)}
    want |= {(2, 1): ("x", None), (2, 3): (None, None), (3, 1): ("b", "u"), (None, 1): ("n", None), (None, 3): ("n3", None)}
    assert got == want
    assert E.turn_pairs(_turns(spark, [])).count() == 0


def _strict(pairs):
    """Fails on a text with 'boom', and as a whole on more than 50 pairs."""
    assert len(pairs) <= 50
    if any("boom" in g for _, g in pairs):
        raise RuntimeError("judge down")
    kinds = {"high": (11, "too good"), "nan": (float("nan"), "-"), "shape": "seven", "text": ("nine", "-")}
    return [kinds.get(g, (len(g), f"{e}/{g}")) for e, g in pairs]


def test_failing_judge_keeps_every_row(spark):
    rows = [(n, "e", "g" * (n % 7)) for n in range(230)]
    rows += [(300, "e", "boom"), (301, "e", "high"), (302, "e", "nan"), (303, "e", "shape"), (304, "e", "text"),
             (305, "e", None), (306, None, "g"), (307, "", ""), (308, "e", "boom again")]
    pairs = spark.createDataFrame(rows, "id long, expected string, generated string").repartition(1)
    scores = E.judge_answers(E.cosine_scores(pairs), _strict)
    got = {r["id"]: r for r in scores.collect()}
    assert len(got) == len(rows)
    assert all(got[n]["judge_score"] == n % 7 and got[n]["error"] is None for n in range(230))
    assert got[300]["error"] == got[308]["error"] == "RuntimeError: judge down"
    assert got[301]["error"] == "score outside 0 to 10: 11" and got[301]["feedback"] == "too good"
    assert got[302]["error"].startswith("score outside") and got[303]["error"].startswith("no score and feedback")
    assert got[304]["error"].startswith("no score and feedback")
    assert got[305]["error"] == E.NO_ANSWER and got[306]["error"] == E.NO_EXPECTED and got[307]["judge_score"] == 0
    assert got[305]["cosine"] is None and got[307]["cosine"] is None
    again = E.retry_list(scores)
    assert sorted(r["id"] for r in again.collect()) == [300, 301, 302, 303, 304, 308]
    merged = E.merge_retries(scores, E.judge_answers(again, lambda ps: [(5, "second look")] * len(ps)), ["id"])
    report = E.score_report(merged).first()
    assert (report["pairs"], report["judged"], report["failed"], report["unanswered"]) == (len(rows), len(rows) - 2, 0, 2)
    assert {r["id"] for r in merged.where("feedback = 'second look'").collect()} == {300, 301, 302, 303, 304, 308}


def test_judge_with_too_few_answers_and_empty_input(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "a", "c")], "id long, expected string, generated string").repartition(1)
    got = E.judge_answers(pairs, lambda ps: [(3, "only one")]).collect()
    assert [(r["judge_score"], r["error"]) for r in got] == [(3.0, None)] * 2
    none = E.judge_answers(pairs, lambda ps: []).collect()
    assert all(r["error"] == "ValueError: 0 answers to 1 pairs" for r in none)
    empty = E.judge_answers(E.cosine_scores(pairs.limit(0)), E.overlap_judge)
    assert empty.count() == 0 and E.score_report(empty).first()["mean_score"] is None


def test_cosine_and_overlap_against_plain_python(spark):
    import hashlib
    rows = [(1, "a b b c", "b c d"), (2, "x", "x"), (3, "p q", "r s"), (4, " \n", "x"), (5, "w " * 50_000, "w v")]
    pairs = spark.createDataFrame(rows, "id long, expected string, generated string")
    got = {r["id"]: r for r in E.judge_answers(E.cosine_scores(pairs), E.overlap_judge).collect()}

    def vector(text):
        v = [0.0] * 64
        for w in text.split():
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        return v

    for n, e, g in rows:
        a, b = vector(e), vector(g)
        size = math.hypot(*a) * math.hypot(*b)
        want = round(sum(x * y for x, y in zip(a, b)) / size, 6) if size else None
        assert got[n]["cosine"] == (pytest.approx(want, abs=1e-6) if want is not None else None)
        x, y = set(re.findall(r"\S+", e)), set(re.findall(r"\S+", g))
        assert got[n]["judge_score"] == 10 * len(x & y) // len(x | y)
