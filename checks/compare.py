"""Run queries next to their SQL and report differences: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    connection = duckdb.connect()
    for name in TABLES.split():
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = connection.execute(sql)
    return [d[0] for d in result.description], [str(d[1]) for d in result.description], result.fetchall()


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def in_order(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_value(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(spark: SparkSession, sf_dir: str, name: str) -> str | None:
    """None if the query and its SQL agree in columns, types and rows."""
    df = QUERIES[name](spark, sf_dir)
    columns, rows = in_order(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if rows else "no rows"
    names, types, wanted = oracle_rows(sf_dir, ORACLES[name])
    expected_columns, expected = in_order(names, wanted)
    found_types = {c: SQL_TYPES.get(t, t) for c, t in df.dtypes}
    if found_types != dict(zip(names, types)):
        return f"types {found_types} expected {dict(zip(names, types))}"
    if columns != expected_columns:
        return f"columns {columns} expected {expected_columns}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows, expected {len(expected)}"
    for got, want in zip(rows, expected):
        if got != want:
            return f"row {got!r:.600} expected {want!r:.600}"
    return None


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.warehouse.dir", "/tmp/litvec-warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            problem = difference(spark, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {error!s:.1200}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
