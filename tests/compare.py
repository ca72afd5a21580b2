"""Side by side: a registered query on Spark, its SQL on DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loreline.plans.bindings import TABLES  # noqa: E402


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, queries, oracles, sf_dir):
    """(rows, problem) of one query; problem is None when both sides agree."""
    df = queries[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return len(got), None
    result = con.execute(oracles[name])
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return len(got), f"columns {got_cols} != {want_cols}"
    if got == want:
        return len(got), None
    extra = [r for r in got if r not in set(want)][:3]
    missing = [r for r in want if r not in set(got)][:3]
    return len(got), f"{len(got)} rows vs {len(want)}; spark only {extra}; sql only {missing}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from loreline.session import build_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    session = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g", spark__driver__host="127.0.0.1",
    )
    session.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = database(sf_dir), entry.queries(), entry.oracle_sql()
    failed = 0
    skip = set() if only else {"topic_growth"}
    for name in only or [q for q in queries if queries[q] and q not in skip]:
        began = time.time()
        try:
            n, problem = compare(session, con, name, queries, oracles, sf_dir)
        except Exception as error:  # report and go on
            n, problem = 0, f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok " if problem is None else "BAD"
        failed += problem is not None
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark} {name}: {n} rows, {time.time() - began:.1f}s{kind} {str(problem or '')[:1500]}", flush=True)
    print(f"{failed} problems")
