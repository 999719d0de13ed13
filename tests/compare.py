"""Run registered queries and their SQL side by side and compare all values."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ", timespec="microseconds")
    return str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> tuple[int, list]:
    """Number of rows, and the first rows that only one side has."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected = result.fetchall()
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    left, right = _rows(df.columns, df.collect()), _rows(names, expected)
    if left == right:
        return len(left), []
    a, b = set(left), set(right)
    only = [("spark", r) for r in sorted(a - b)[:3]] + [("sql", r) for r in sorted(b - a)[:3]]
    return len(left), only or [("counts", len(left), len(right))]
