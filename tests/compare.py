"""Runs queries in Spark and their SQL in DuckDB and compares the rows.

python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("", "null")
    if isinstance(v, bool):
        return ("b", str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return ("n", f"{float(v):.10g}")
    return ("s", str(v))


def rows_of(columns: list[str], rows) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def check(spark, con, name: str, run, sql: str | None, sf_dir: str) -> str:
    df = run(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only ({len(mine)})"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    theirs = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} vs {sorted(cols)}"
    if mine != theirs:
        a, b = [r for r in mine if r not in theirs][:3], [r for r in theirs if r not in mine][:3]
        return f"FAIL {len(mine)} vs {len(theirs)} rows; spark {a}; sql {b}"
    return f"ok ({len(mine)})"


if __name__ == "__main__":
    from tallyframe.plans import QUERIES, SQL
    from tallyframe.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    folder = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(), duck(folder), 0
    for n in names:
        t = time.time()
        try:
            out = check(spark, con, n, QUERIES[n], SQL.get(n), folder)
        except Exception as e:  # noqa: BLE001
            out = f"FAIL {type(e).__name__}: {str(e)[:700]}"
        bad += out.startswith("FAIL")
        print(f"{n}: {out} [{time.time() - t:.1f}s]", flush=True)
    print("failed:", bad, "of", len(names))
