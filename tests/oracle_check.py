"""Compare registered queries with their SQL in DuckDB: python tests/oracle_check.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


SIMPLE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> list[str]:
    """What differs: columns, types, row count, values."""
    df = query(spark, sf_dir)
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    want = sorted_rows(columns, result.fetchall())
    problems = []
    if sorted(df.columns) != sorted(columns):
        problems.append(f"columns {sorted(df.columns)} != {sorted(columns)}")
    for column, kind in df.dtypes:
        if SIMPLE.get(kind, kind) != types.get(column):
            problems.append(f"type of {column}: {kind} != {types.get(column)}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    elif got != want:
        first = next((g, w) for g, w in zip(got, want) if g != w)
        problems.append(f"values differ, first {str(first)[:600]}")
    if not got:
        problems.append("no rows")
    return problems


def main() -> int:
    from rillway.plans.catalogue import ORACLES, QUERIES
    from rillway.session import build_session, drop_scratch

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or sorted(QUERIES)
    spark = build_session(
        "oracle-check",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problems = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir) if name in ORACLES else [
                f"rows only: {QUERIES[name](spark, sf_dir).count()}"
            ]
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {'; '.join(problems)}", flush=True)
    drop_scratch(spark)
    print(f"{len(names)} queries, {failed} with problems")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
