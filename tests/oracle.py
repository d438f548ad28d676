"""Runs registered queries beside their SQL and compares every value."""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple") or isinstance(v, float):
        f = float(v)
        return str(int(f)) if f == int(f) and abs(f) < 1e15 else repr(f)
    if isinstance(v, dict):
        return str({str(k): cell(x) for k, x in sorted(v.items())})
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = normal([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} vs {len(want)}\n  spark only: {only_got}\n  sql only:   {only_want}"
    return f"ok {len(got)}"


def main(folder: str, names: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name in queries:
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            df = queries[name](spark, folder)
            res = compare(df, con, oracles[name]) if name in oracles else f"rows-only {len(df.collect())}"
        except Exception as ex:  # report and go on
            res = f"ERROR {type(ex).__name__}: {str(ex)[:1200]}"
        ok = res.startswith(("ok", "rows-only"))
        bad += not ok
        print(f"{'PASS' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {res}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
