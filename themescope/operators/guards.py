"""Checks that stop a step before it produces something meaningless."""

from __future__ import annotations

from pyspark.sql import DataFrame


def need_more_rows_than(rows: int, k: int) -> None:
    if k < 1:
        raise ValueError("k must be at least 1")
    if rows <= k:
        raise ValueError(f"{rows} complaints are too few for {k} clusters")


def need_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail if the table is empty; looks at one row only."""
    if not df.take(1):
        raise ValueError(message)
    return df


def usable_ks(ks: list[int], rows: int) -> list[int]:
    """The values of k that are smaller than the number of rows."""
    if any(k < 1 for k in ks):
        raise ValueError("k must be at least 1")
    return [k for k in ks if k < rows]
