"""Runs registered queries next to their SQL statements and compares rows without order.

``python -m tests.oracle [sf] [name part ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from workloads.analogue import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def table_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, statement: str, sf_dir: str) -> str:
    df = fn(spark, sf_dir)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    relation = con.execute(statement)
    want = table_of([d[0] for d in relation.description], relation.fetchall())
    if got[0] != want[0]:
        return f"columns differ: {got[0]} / {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"row counts differ: {len(got[1])} / {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else f"ok {len(got[1])}"


def main() -> int:
    import __spark_entry__ as entry
    from proofledger.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    statements = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if args and not any(part in name for part in args):
            continue
        start = time.time()
        try:
            if name in statements:
                result = compare(spark, con, fn, statements[name], sf_dir)
            else:
                result = f"ok {len(fn(spark, sf_dir).collect())} (no SQL)"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += not result.startswith("ok")
        print(f"{time.time() - start:7.2f}s  {name}: {result}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
