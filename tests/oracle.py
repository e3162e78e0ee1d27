"""Side-by-side comparison of a query with its SQL on the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if abs(value) > 1e6 else round(value, 5)
    return value


def _key(row):
    return tuple((value is None, str(type(value)), str(value)) for value in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda index: columns[index])
    plain = [tuple(_cell(row[index]) for index in order) for row in rows]
    return [columns[index] for index in order], sorted(plain, key=_key)


def spark_result(df):
    return rows_of(df.columns, [tuple(row) for row in df.collect()])


def duckdb_result(connection, sql):
    result = connection.execute(sql)
    return rows_of([column[0] for column in result.description], result.fetchall())
