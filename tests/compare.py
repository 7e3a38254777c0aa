"""Run catalog queries on Spark and their oracles on DuckDB and compare whole results."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted([tuple(_cell(row[i]) for i in order) for row in rows], key=repr)


def difference(spark, connection, sf_dir: str, query, sql: str) -> tuple[str | None, int, float]:
    """None if equal, else a short description; plus row count and Spark seconds."""
    start = time.time()
    df = query(spark, sf_dir)
    got_names, got = _rows(df.columns, [tuple(row) for row in df.collect()])
    seconds = time.time() - start
    cursor = connection.execute(sql)
    want_names, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got), seconds
    if got == want:
        return None, len(got), seconds
    extra = [r for r in got if r not in set(want)][:2]
    lacking = [r for r in want if r not in set(got)][:2]
    short = [[tuple(str(c)[:60] for c in r) for r in side] for side in (extra, lacking)]
    return f"rows {len(got)}/{len(want)}; only Spark {short[0]}; only DuckDB {short[1]}", len(got), seconds
