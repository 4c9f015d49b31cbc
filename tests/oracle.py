"""Compare registered queries with their SQL on the same Parquet files: python -m tests.oracle [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(folder: str):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return repr(float(f"{v:.12g}")) if v != int(v) or abs(v) > 1e15 else str(int(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return str(v)


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(name, spark, con, queries, oracles, folder=SF_DIR):
    df = queries[name](spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return got[1] != [], f"{len(got[1])} rows, no SQL"
    cur = con.execute(oracles[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns differ: {sorted(set(got[0]) ^ set(want[0]))}"
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} vs {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, a, b) for c, a, b in zip(got[0], g, w) if a != b]
        return False, f"{len(bad)} rows differ, first: {diff[:4]} of {g[:3]}"
    return True, f"{len(got[1])} rows"


def main(names):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from shopgrain.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(SF_DIR)
    qs, sql = e.queries(), e.oracle_sql()
    failed = []
    for n in names or list(qs):
        t = time.time()
        try:
            ok, msg = compare(n, spark, con, qs, sql)
        except Exception as ex:  # report and go on
            ok, msg = False, f"{type(ex).__name__}: {str(ex)[:1500]}"
        if not ok:
            failed.append(n)
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {msg}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
