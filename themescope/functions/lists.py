"""List columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def each_item(df: DataFrame, items: str) -> DataFrame:
    """One row per element of a list column, under the same name; empty lists give no row.

    A plain explode makes Spark test the list for emptiness below it, which computes a derived
    list once more; the outer form has no such test, and its one NULL row is dropped after it.
    """
    cells = [F.explode_outer(items).alias(items) if c == items else F.col(f"`{c}`") for c in df.columns]
    return df.select(*cells).filter(F.col(items).isNotNull())
