"""Reproducible sampling: every draw is a hash of the row's key.

The same rows are drawn whatever the partitioning, and no sort of the whole table is needed:
a histogram of the draws tells up to which draw each group is kept, and only the rows of the
result are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from themescope import fixed_values as fv
from themescope.functions.draws import draw_bucket, draw_hash, unit_draw
from themescope.operators.small import small_side

_HISTOGRAM_DIGITS = 4


def thin_stratum(
    df: DataFrame, stratum: Column, fraction: float = fv.STRATUM_FRACTION,
    key: str = "complaint_id", seed: int = fv.SEED,
) -> DataFrame:
    """Keep a share of one stratum and all other rows; a fraction of 1 or more keeps all."""
    if fraction >= 1.0:
        return df
    return df.filter(~stratum | (unit_draw(key, seed) < F.lit(float(fraction))))


def draw_histogram(df: DataFrame, group: str, key: str, seed: int | str, digits: int) -> DataFrame:
    """Rows per group and draw bucket; combined before the shuffle."""
    bucket = draw_bucket(draw_hash(key, seed), digits)
    return df.groupBy(group, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))


def cap_edges(histogram: DataFrame, group: str, cap: int) -> DataFrame:
    """For each group of at least ``cap`` rows: the bucket holding the cap-th draw, and how many
    rows of that bucket still belong to the sample."""
    upto = F.sum("_n").over(W.partitionBy(group).orderBy("_bucket"))
    return (
        histogram.withColumn("_upto", upto)
        .withColumn("_room", F.lit(cap) - (F.col("_upto") - F.col("_n")))
        .filter((F.col("_room") > 0) & (F.col("_upto") >= cap))
        .select(group, F.col("_bucket").alias("_edge"), "_room")
    )


def _keep_to_edges(
    df: DataFrame, edges: DataFrame, group: str, key: str, seed: int | str, digits: int
) -> DataFrame:
    digest = draw_hash(key, seed)
    near = (
        df.join(small_side(edges), group, "left")
        .withColumn("_digest", digest)
        .withColumn("_bucket", draw_bucket(F.col("_digest"), digits))
        .filter(F.col("_edge").isNull() | (F.col("_bucket") <= F.col("_edge")))
    )
    # Only the edge bucket needs ranking; partitioning by bucket keeps a hot group spread out.
    rank = F.row_number().over(W.partitionBy(group, "_bucket").orderBy("_digest", key))
    return (
        near.withColumn("_rank", rank)
        .filter(
            F.col("_edge").isNull()
            | (F.col("_bucket") < F.col("_edge"))
            | (F.col("_rank") <= F.col("_room"))
        )
        .select(df.columns)
    )


def cap_groups(
    df: DataFrame, group: str, cap: int, key: str = "complaint_id", seed: int | str = fv.SEED,
    digits: int = _HISTOGRAM_DIGITS,
) -> DataFrame:
    """At most ``cap`` random rows per group; smaller groups stay whole, NULL groups and NULL keys are dropped."""
    grouped = df.filter(F.col(group).isNotNull() & F.col(key).isNotNull())
    edges = cap_edges(draw_histogram(grouped, group, key, seed, digits), group, cap)
    return _keep_to_edges(grouped, edges, group, key, seed, digits)


def first_draws(
    df: DataFrame, rows: int, key: str = "complaint_id", seed: int | str = fv.SEED,
    digits: int = _HISTOGRAM_DIGITS,
) -> DataFrame:
    """Exactly ``min(rows, n)`` random rows.

    The whole table is one group.  A sort with a limit would give the same rows, but every task
    would send that many wide rows to a single one; the histogram reads keys only.
    """
    marked = df.withColumn("_all", F.lit(1))
    return cap_groups(marked, "_all", rows, key, seed, digits).drop("_all")


def shuffle_rows(df: DataFrame, key: str = "complaint_id", seed: int | str = fv.SEED) -> DataFrame:
    """All rows in random, reproducible order."""
    return df.orderBy(draw_hash(key, seed), key)


def category_cap(categories: int, target: int = fv.SAMPLE_TARGET) -> int:
    return max(target // max(categories, 1), 1)


def balanced_sample(
    df: DataFrame, group: str = "product", target: int = fv.SAMPLE_TARGET,
    key: str = "complaint_id", seed: int = fv.SEED, digits: int = _HISTOGRAM_DIGITS,
) -> DataFrame:
    """Equal share per category, then filled up to ``target`` from the rows left over.

    ``df`` is read for the group counts, the histogram and the result, so land it first when
    it is costly to derive.
    """
    grouped = df.filter(F.col(group).isNotNull() & F.col(key).isNotNull())
    sizes = small_side(grouped.groupBy(group).agg(F.count(F.lit(1)).alias("_n")))
    categories = sizes.count()
    cap = category_cap(categories, target)
    picked = sizes.agg(F.sum(F.least("_n", F.lit(cap))).alias("picked")).first().picked or 0
    capped = cap_groups(grouped, group, cap, key, seed, digits)
    if picked >= target:
        return capped
    return capped.unionByName(
        first_draws(left_over(grouped, capped, key), target - picked, key, f"{seed}-fill", digits)
    )


def left_over(df: DataFrame, taken: DataFrame, key: str = "complaint_id") -> DataFrame:
    """Rows whose key was not taken."""
    return df.join(small_side(taken.select(key)), key, "left_anti")


def holdout(
    truth: DataFrame, rows: int = fv.HOLDOUT_ROWS, key: str = "complaint_id", seed: int = fv.SEED
) -> DataFrame:
    """A fixed number of labelled rows for manual review; all of them if there are fewer."""
    return first_draws(truth, rows, key, f"{seed}-holdout")
