"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb  # noqa: E402

from quarry.plans import catalog  # noqa: E402
from quarry.session import build_session  # noqa: E402
from quarry.sources.tables import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return repr(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in records)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    keys = [a for a in args if not a.startswith("/")]
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, os_ = catalog.queries(), catalog.oracle_sql()
    keys = keys or sorted(qs)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            sdf = qs[k](spark, sf)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in os_:
            print(f"ROWS {k}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            cur = con.execute(os_[k])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(ocols):
            print(f"FAIL {k}: columns {sorted(scols)} vs {sorted(ocols)}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(ocols, orows)
        if a == b:
            print(f"OK   {k}: {len(a)} rows {ts:.1f}s")
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL {k}: {len(a)} vs {len(b)} rows; only spark {list(sa - sb)[:3]}; "
                  f"only oracle {list(sb - sa)[:3]}")
    print(f"{len(keys) - bad}/{len(keys)} ok")


if __name__ == "__main__":
    main()
