"""Compare every registered query with its SQL, the way the round check does: python tests/compare.py [names]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return db


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return float(v)
    return v if isinstance(v, (str, float)) else str(v)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    values = [tuple(_value(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(values, key=repr)


def spark_rows(spark, name: str, sf_dir: str):
    df = entry.queries()[name](spark, sf_dir)
    return rows_of(df.columns, df.collect())


def sql_rows(db, name: str):
    result = db.execute(entry.oracle_sql()[name])
    return rows_of([d[0] for d in result.description], result.fetchall())


def main() -> None:
    from seekledger.session import local_session

    args = [a for a in sys.argv[1:] if not a.startswith("/")]
    sf_dir = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    spark, db = local_session(), connect(sf_dir)
    bad = 0
    for name in entry.queries():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            got = spark_rows(spark, name, sf_dir)
            took = time.time() - start
            want = sql_rows(db, name) if name in entry.oracle_sql() else None
        except Exception as error:
            bad += 1
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            continue
        if want is None:
            print(f"rows  {name} {len(got[1])} {took:.2f}s", flush=True)
        elif got == want:
            print(f"ok    {name} {len(got[1])} {took:.2f}s", flush=True)
        else:
            bad += 1
            print(f"DIFF  {name} {got[0]} {want[0]} rows {len(got[1])} {len(want[1])}")
            pairs = [(g, w) for g, w in zip(got[1], want[1]) if g != w][:2]
            print("   ", pairs, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
