"""Reproducible random draws: a hash of key and seed, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HEX = 8


def draw_hash(key: str, seed: int | str) -> Column:
    """Hex digest that serves as the random sort key of a row."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def draw_bucket(digest: Column, hex_digits: int) -> Column:
    """The leading digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")


def unit_draw(key: str, seed: int | str) -> Column:
    """Uniform draw in [0, 1)."""
    return draw_bucket(draw_hash(key, seed), _HEX) / F.lit(float(16**_HEX))
