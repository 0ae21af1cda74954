"""Late rows of the windowed counts: counted, reported per batch, never lost."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.streaming import jobs

SCHEMA = "ts timestamp_ntz, value double, n long"
DAY = dt.datetime(2024, 3, 1)


def _at(hours):
    return None if hours is None else DAY + dt.timedelta(hours=hours)


def test_late_rows_add_up(spark, tmp_path):
    drops = [[0, 5, 30, None], [29, 10, 70, None], [], [50, 21, 3, 71, 71], [None, 68]]
    base, delay = str(tmp_path), 20
    want_late, newest = [], None
    for n, hours in enumerate(drops):
        rows = [(_at(h), 1.0, n) for h in hours]
        spark.createDataFrame(rows, SCHEMA).repartition(1).write.parquet(f"{base}/in/{n}")
        got = jobs.stream_daily_counts(spark, base + "/in/*", SCHEMA, base + "/out", base + "/ckpt", delay=f"{delay} hours")
        want_late.append(sum(h is not None and newest is not None and h < newest - delay for h in hours))
        newest = max([h for h in [newest, *hours] if h is not None], default=None)
    rows = {r["window_start"]: r for r in got.collect()}
    flat = [h for d in drops for h in d]
    assert sum(r["events"] for r in rows.values()) == len(flat)
    assert rows[None]["events"] == 3 and rows[None]["late_events"] == 0
    for day in range(3):
        assert rows[DAY + dt.timedelta(days=day)]["events"] == sum(h is not None and h // 24 == day for h in flat)
    assert sum(r["late_events"] for r in rows.values()) == sum(want_late) > 0
    report = jobs.batch_report(spark, base + "/out").collect()
    assert sorted(r["late_events"] for r in report) == sorted(x for x, d in zip(want_late, drops) if d)
    assert sum(r["events"] for r in report) == len(flat)
    again = jobs.stream_daily_counts(spark, base + "/in/*", SCHEMA, base + "/out", base + "/ckpt", delay=f"{delay} hours")
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, rows.values()), key=repr)


def test_marks_are_no_part_of_the_counts(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([(_at(None), 2.0, 1)], SCHEMA).write.parquet(base + "/in/0")
    spark.createDataFrame([(_at(1), 2.0, 1)], SCHEMA).write.parquet(base + "/in/1")
    got = jobs.stream_daily_counts(spark, base + "/in/*", SCHEMA, base + "/out", base + "/ckpt")
    assert sorted((r["events"], r["late_events"]) for r in got.collect()) == [(1, 0), (1, 0)]
    assert spark.read.parquet(base + "/out").agg(F.sum("events")).first()[0] == 2
