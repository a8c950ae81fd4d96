"""Compare a query with its SQL twin on the smallest tables."""

from __future__ import annotations

import os
from functools import cache
from pathlib import Path

import duckdb
import pandas as pd

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@cache
def views() -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else path
        connection.execute(f"create view {path.stem} as select * from '{files}'")
    return connection


def _cell(value) -> str:
    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value).replace("+00:00", "")


def rows_of(frame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(_cell, row)) for row in frame.itertuples(index=False))


def same(spark, query, sql: str) -> None:
    got, want = query(spark, FOLDER).toPandas(), views().execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
