"""Side-by-side comparison of a Spark result and its SQL check."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def _value(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(v)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def difference(df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if equal, else a short description."""
    relation = db.sql(sql)
    theirs = rows_of(relation.columns, relation.fetchall())
    ours = rows_of(df.columns, df.collect())
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    if ours == theirs:
        return None
    known, made = set(theirs), set(ours)
    extra = [r for r in ours if r not in known][:2]
    lacking = [r for r in theirs if r not in made][:2]
    return f"rows {len(ours)} != {len(theirs)}; only Spark {extra}; only SQL {lacking}"
