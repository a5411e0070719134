"""Run registered queries and compare each with its SQL on the same tables."""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark import workload  # noqa: E402
from tidemark.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(value):
    if value is None:
        return "∅"
    if isinstance(value, float):
        if math.isnan(value):
            return "∅"
        return repr(round(value, 9))
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ") if hasattr(value, "hour") else value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    args = ap.parse_args()
    only = [x for x in args.only.split(",") if x]
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{args.sf}/{t}.parquet'")
    bad = 0
    for name, entry in workload.load().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            t0 = time.time()
            df = entry.run(spark, args.sf)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - t0
            plan = df._jdf.queryExecution().executedPlan().toString()
            for join in ("CartesianProduct", "BroadcastNestedLoopJoin"):
                if join in plan:
                    print(f"PLAN  {name} has {join}")
            if entry.sql is None:
                print(f"rows  {name} n={len(got)} {took:.2f}s")
                continue
            t0 = time.time()
            rel = con.sql(entry.sql)
            want = rel.fetchall()
            sql_took = time.time() - t0
            if sorted(rel.columns) != sorted(df.columns):
                bad += 1
                print(f"COLS  {name} spark={sorted(df.columns)} sql={sorted(rel.columns)}")
                continue
            a, b = rows_of(df.columns, got), rows_of(rel.columns, want)
            if a == b:
                note = "" if a else "  EMPTY"
                print(f"ok    {name} n={len(a)} {took:.2f}s sql={sql_took:.2f}s{note}")
            else:
                bad += 1
                sa, sb = set(a), set(b)
                print(f"DIFF  {name} spark={len(a)} sql={len(b)} cols={sorted(df.columns)}")
                print("   only spark:", sorted(sa - sb)[:3])
                print("   only sql:  ", sorted(sb - sa)[:3])
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(exc).__name__}: {str(exc)[:700]}")
        sys.stdout.flush()
    print("problems:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
