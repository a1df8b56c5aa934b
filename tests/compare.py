"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime
from collections import Counter
from decimal import Decimal

import duckdb

from docketry.plans.oracle import ORACLES
from docketry.plans.registry import QUERIES
from docketry.plans.views import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def canonical(value):
    """Type and value as text, so that 1, 1.0 and True stay apart."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"bool {value}"
    if isinstance(value, int):
        return f"int {value}"
    if isinstance(value, Decimal):
        return f"decimal {value}"
    if isinstance(value, float):
        return f"float {value!r}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return f"time {value.isoformat()}"
    return f"{type(value).__name__} {value}"


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(row[i]) for i in order) for row in rows)


def differences(spark, folder: str, name: str, con=None):
    """(only in Spark, only in SQL, number of Spark rows, column names differ)."""
    con = con or connect(folder)
    frame = QUERIES[name](spark, folder)
    ours = rows_of(frame.columns, frame.collect())
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    names = sorted(frame.columns) != sorted(columns)
    return ours - theirs, theirs - ours, sum(ours.values()), (sorted(frame.columns), sorted(columns)) if names else None
