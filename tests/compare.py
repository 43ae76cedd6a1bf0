"""Row-for-row comparison of a Spark result with DuckDB SQL over the same files."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _value(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(repr(value))
    return value


def rows_of(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def differences(connection: duckdb.DuckDBPyConnection, sql: str, df, shown: int = 3) -> str:
    """Empty if both results hold the same rows under the same names, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but SQL has {sorted(names)}"
    expected = rows_of(names, result.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if expected == actual:
        return ""
    missing, extra = expected - actual, actual - expected
    return (
        f"{expected.total()} rows expected, {actual.total()} found; {missing.total()} missing e.g. "
        f"{list(missing)[:shown]}; {extra.total()} extra e.g. {list(extra)[:shown]}"
    )
