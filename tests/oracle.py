"""Compares a query with its SQL in DuckDB on one folder of tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connection(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return str(value).replace("+00:00", "") if hasattr(value, "isoformat") else value


def rows_of(rows, names: list[str]) -> list[tuple]:
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def same(frame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.collect(), frame.columns) == rows_of(found.fetchall(), names)
