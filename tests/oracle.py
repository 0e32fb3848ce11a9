"""Compare queries with their SQL in DuckDB: names, rows and values must be equal.

Run ``python tests/oracle.py [sf] [name ...]`` to check some or all queries.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = os.environ.get("EMBERLINE_TESTDATA", "/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/sf{sf}/{t}.parquet')")
    return con


def cell(x):
    """A value in a form that both engines share; numbers keep their kind."""
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(cell(v) for v in x)
    return x


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "MapInPandas", "FlatMapGroups"]


def forbidden_nodes(df) -> list[str]:
    """Cross joins, nested loops and Python workers in the physical plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [n for n in FORBIDDEN if n in plan]


def compare(spark, con, fn, sql: str, sf: str) -> str | None:
    """Nothing if the plan is clean and the result equal, else what is wrong."""
    df = fn(spark, f"{DATA}/sf{sf}")
    if forbidden_nodes(df):
        return f"plan holds {forbidden_nodes(df)}"
    got = canonical(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = canonical(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    if not got:
        return "no rows"
    for g, w in zip(got, want):
        if repr(g) != repr(w):
            bad = [(c, a, b) for c, a, b in zip(sorted(names), g, w) if repr(a) != repr(b)]
            return f"values {bad[:4]} in {g[:6]}"
    return None


def main() -> int:
    from emberline.catalog import ORACLES, QUERIES
    from emberline.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("oracle", 8, **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, QUERIES[name], ORACLES[name], sf)
            else:
                n = len(QUERIES[name](spark, f"{DATA}/sf{sf}").collect())
                problem = None if n else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - t0:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed of {len(names)}")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
