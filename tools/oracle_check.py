"""Local twin of the driver's correctness gate: run each registered query on
Spark and its SQL on DuckDB over the same parquet files; compare column
names, row counts and the multiset of rows (columns sorted by name).

usage: python tools/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import duckdb
    from spanflow.plans.registry import load_all_plans
    from spanflow.session import get_spark
    from spanflow.sources.tables import TABLES
    spark = get_spark(8)
    Q, O = load_all_plans()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    names = a.names or list(Q)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = Q[n](spark, a.sf)
            cols = df.columns
            rows = df.collect()
            ts = time.time() - t0
        except Exception as e:  # noqa
            print(f"FAIL-SPARK {n}: {str(e)[:400]}")
            bad += 1
            continue
        if n not in O:
            print(f"ROWS-ONLY {n}: rows={len(rows)} cols={cols} spark={ts:.1f}s")
            continue
        t1 = time.time()
        try:
            rel = con.sql(O[n])
            ocols = rel.columns
            orows = rel.fetchall()
        except Exception as e:  # noqa
            print(f"FAIL-SQL {n}: {str(e)[:400]}")
            bad += 1
            continue
        td = time.time() - t1
        if sorted(cols) != sorted(ocols):
            print(f"MISMATCH-COLS {n}: spark={cols} sql={ocols}")
            bad += 1
            continue
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
        s = Counter(tuple(norm(r[i]) for i in order) for r in rows)
        o = Counter(tuple(norm(r[i]) for i in oorder) for r in orows)
        if s == o:
            print(f"OK {n}: rows={len(rows)} spark={ts:.1f}s duck={td:.1f}s")
        else:
            bad += 1
            ds, do = s - o, o - s
            print(f"MISMATCH {n}: rows spark={len(rows)} sql={len(orows)} "
                  f"only-spark={sum(ds.values())} e.g. {list(ds)[:2]} only-sql={sum(do.values())} e.g. {list(do)[:2]}")
    print(f"done: {len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
