"""Compare a query's rows with those of its SQL equivalent."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def open_tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    return repr(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, as messages; empty if all is equal."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} != {sorted(columns)}"]
    actual = rows_of(df.columns, df.collect())
    if len(actual) != len(expected):
        return [f"{len(actual)} rows, expected {len(expected)}"]
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    return [f"{len(wrong)} rows differ, e.g. {wrong[0]}"] if wrong else []


def plan_of(df) -> str:
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
