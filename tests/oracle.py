"""Compare registered queries with their DuckDB oracle: python -m tests.oracle [sf] [names...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Queries that SQL cannot express, and the test that holds each against stated cases.
UNIT_TESTED = {
    "chunks": "test_text.py::test_chunks_worked_out_by_hand",
    "html_sections": "test_sources.py::test_html_sections_and_markdown",
    "html_to_markdown": "test_sources.py::test_html_sections_and_markdown",
    "cross_source_dedup": "test_dedup.py::test_cross_source_dedup",
    "corroboration": "test_dedup.py::test_corroborate",
}


def unit_tested(name: str) -> bool:
    file, _, test = UNIT_TESTED.get(name, "::").partition("::")
    path = Path(__file__).parent / file
    return bool(test) and f"def {test}(" in path.read_text()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, Decimal, float)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir, name=""):
    """(ok, detail, spark rows); without SQL only a query with a test of its own is ok"""
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        ok = unit_tested(name)
        return ok, "rows only" if ok else "neither SQL nor a test of its own", len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got)
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(cols, want)
    if a == b:
        return True, "match", len(got)
    only_a, only_b = list((a - b).elements())[:2], list((b - a).elements())[:2]
    return False, (
        f"rows {len(got)} vs {len(want)}; spark-only {sum((a - b).values())} {str(only_a)[:700]}; "
        f"oracle-only {sum((b - a).values())} {str(only_b)[:700]}"
    ), len(got)


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from quillstone.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = argv[1:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            ok, detail, n = compare(spark, con, fn, oracles.get(name), sf_dir, name)
        except Exception as exc:  # report and go on with the next query
            ok, detail, n = False, f"{type(exc).__name__}: {str(exc)[:900]}", -1
        bad += not ok
        flag = "ok  " if ok else "FAIL"
        empty = " EMPTY" if n == 0 else ""
        print(f"{flag} {name} rows={n}{empty} {time.time() - start:.1f}s {'' if ok and detail == 'match' else detail}", flush=True)
    print(f"failures: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
