"""Compare a plan with its SQL, column by column and row by row, in any order."""

from __future__ import annotations

import math
from pathlib import Path
from typing import Any

import duckdb
from pyspark.sql import DataFrame

SMALL = "/root/testdata/sf0.001"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


def _plain(value: Any) -> Any:
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def _rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(type(v)), str(v)) for v in row))


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same rows, else what differs."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    mine = _rows(df.columns, [tuple(row) for row in df.collect()])
    wanted = _rows(names, expected)
    if len(mine) != len(wanted):
        return f"{len(mine)} rows != {len(wanted)}"
    for left, right in zip(mine, wanted):
        if left != right:
            return f"{left} != {right} (columns {sorted(names)})"
    return None
