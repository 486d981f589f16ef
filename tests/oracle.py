"""Run queries against their SQL: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def _kind(v):
    return type(v).__name__


def compare(spark_df, con, sql: str) -> str | None:
    """None when rows, column names and values agree, else what differs."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    cols = sorted(names)
    want = [tuple(_plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()]
    got = [tuple(_plain(r[c]) for c in cols) for r in spark_df.collect()]
    if len(want) != len(got):
        return f"rows {len(got)} vs {len(want)}"
    if not want:
        return "both sides are empty"
    a, b = sorted(got, key=repr), sorted(want, key=repr)
    for x, y in zip(a, b):
        if x != y:
            return f"first difference:\n   spark {str(x)[:600]}\n   sql   {str(y)[:600]}"
        if [_kind(v) for v in x] != [_kind(v) for v in y]:
            return f"types {[_kind(v) for v in x]} vs {[_kind(v) for v in y]} of {cols}"
    return None


def main(argv: list[str]) -> int:
    from rowloom.reports import QUERIES, SQL
    from rowloom.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problem = compare(df, con, SQL[name]) if name in SQL else f"(no SQL) {len(df.collect())} rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        ok = problem is None or problem.startswith("(no SQL)")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
