"""Small tables for joins, by their measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from themescope.session import cut_lineage


def small_side(df: DataFrame) -> DataFrame:
    """A table of one row per group, as one side of a join.

    It is computed once and written, so Spark plans the join with the bytes it takes: below
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and the wide side is not shuffled,
    above it the join is a distributed one.
    """
    return cut_lineage(df)
