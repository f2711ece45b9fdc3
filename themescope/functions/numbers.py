"""Rounding for reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_even(value: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: how array libraries round doubles."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale
