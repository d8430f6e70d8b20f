"""Spark's rows against DuckDB's over the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import numpy as np


def plain(value):
    if value is None or isinstance(value, (str, bool, bytes, datetime.datetime)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, (int, np.integer)):
        return int(value)
    return tuple(plain(x) for x in (value.values() if isinstance(value, dict) else value))


def same(spark, tables: str, query, sql: str) -> int:
    """The number of rows, if both sides have the same."""
    con = duckdb.connect()
    for at in Path(tables).glob("*.parquet"):
        con.execute(f"CREATE VIEW {at.stem} AS SELECT * FROM '{at}'")
    df = query(spark, tables)
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=str)
    assert ours == theirs
    return len(ours)
