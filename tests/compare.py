"""Run queries next to their SQL twins: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

TABLES = ("customer", "events", "documents", "embeddings", "labels", "benchmark")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def difference(spark, con, folder: str, name: str) -> str:
    """Empty when both sides give the same columns and the same bag of rows."""
    ours = contract.queries()[name](spark, folder)
    order = sorted(ours.columns)
    got = Counter(tuple(r[c] for c in order) for r in ours.toArrow().to_pylist())
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    if sorted(columns) != order:
        return f"columns {order} against {sorted(columns)}"
    at = [columns.index(c) for c in order]
    want = Counter(tuple(r[i] for i in at) for r in cursor.fetchall())
    if got == want:
        return ""
    only = [list((x - y).items())[:2] for x, y in ((got, want), (want, got))]
    return f"{got.total()} against {want.total()} rows of {order}; ours {only[0]}, SQL {only[1]}"


def main() -> int:
    from passbook.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(contract.queries())
    folder = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    con = connect(folder)
    bad = 0
    for name in names:
        started = time.time()
        try:
            problem = difference(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - started:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
