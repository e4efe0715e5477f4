"""Run every registered query and its SQL on the same tables and compare them row by row."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def cell(value):
    """Numbers compare by value, whatever their type; doubles must agree in every digit."""
    if isinstance(value, decimal.Decimal | bool | int):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(cell(row[i]) for i in order) for row in data], key=repr)


def differences(spark, folder: str, run, sql: str) -> str | None:
    """None when both agree, otherwise what differs."""
    mine = run(spark, folder)
    got = rows(mine.columns, [tuple(r) for r in mine.collect()])
    with connect(folder) as db:
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        want = rows(names, result.fetchall())
    if sorted(mine.columns) != sorted(names):
        return f"columns {sorted(mine.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} against {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from conftest import build_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:] or list(entry.queries())
    session, bad = build_session(), 0
    for name in chosen:
        start = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            problem = differences(session, folder, entry.queries()[name], sql) if sql else "no SQL"
        except Exception as error:  # noqa: BLE001 - reported
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree")
