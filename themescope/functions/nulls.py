"""Null rules that SQL's three-valued logic does not give by itself."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from themescope.fixed_values import NULL_TOKENS


def not_listed(value: Column, listed: Iterable[str]) -> Column:
    """True unless ``value`` is in the drop list; a NULL value is kept."""
    return value.isNull() | ~value.isin(list(listed))


def has_prefix(value: Column, prefix: str) -> Column:
    """Prefix test that is false, not NULL, for a NULL value."""
    return F.coalesce(value.startswith(prefix), F.lit(False))


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def null_tokens(df: DataFrame, columns: Iterable[str], tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """Read the given spellings of "missing" as NULL in the chosen columns."""
    tokens = list(tokens)
    return df.withColumns(
        {c: F.when(~F.col(c).isin(tokens), F.col(c)) for c in columns}
    )


def whole_id(text: Column) -> Column:
    """Integer key from text, also when it was written as ``10298545.0``; NULL if it is no number."""
    return text.try_cast("decimal(20,0)").try_cast("bigint")
