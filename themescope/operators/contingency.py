"""Agreement of a clustering with true categories.

Every score comes from one contingency table: rows are combined to (category, cluster, count)
before the only shuffle of row data, so neither a dominant category nor a dominant cluster
meets in one task, and everything after works on categories x clusters rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from themescope import fixed_values as fv
from themescope.functions.numbers import round_even
from themescope.operators.small import small_side
from themescope.session import cut_lineage


def contingency(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Rows per true category and predicted cluster, as ``(truth, cluster, n)``."""
    return (
        df.filter(F.col(truth).isNotNull() & F.col(cluster).isNotNull())
        .groupBy(F.col(truth).alias("truth"), F.col(cluster).alias("cluster"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stored_contingency(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """The same table, written once: for callers that derive several results from it."""
    return cut_lineage(contingency(df, truth, cluster))


def with_support(cells: DataFrame) -> DataFrame:
    """Add the size of each cell's category."""
    return cells.withColumn("support", F.sum("n").over(W.partitionBy("truth")))


def supported(cells: DataFrame, minimum: int = fv.MIN_CATEGORY_SUPPORT) -> DataFrame:
    """Only categories large enough to be recoverable."""
    return with_support(cells).filter(F.col("support") >= minimum).drop("support")


def supported_rows(
    df: DataFrame, truth: str, minimum: int = fv.MIN_CATEGORY_SUPPORT
) -> DataFrame:
    """Rows whose category is large enough, for callers that need rows, not counts."""
    large = (
        df.filter(F.col(truth).isNotNull()).groupBy(truth).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= minimum).select(truth)
    )
    return df.join(small_side(large), truth, "left_semi")


def _pairs(count: Column) -> Column:
    return count * (count - 1.0) / 2.0


def agreement(cells: DataFrame) -> DataFrame:
    """Adjusted Rand index and normalised mutual information, one row.

    Sums over categories or clusters are taken cell by cell: a sum of f(size) over categories is
    the sum of n * f(size) / size over cells, so two windows on the small table are all it needs.
    Natural logarithms; mutual information is divided by the mean of both entropies.
    """
    n, t, c = (F.col(x).cast("double") for x in ("n", "_t", "_c"))
    total = F.col("total")
    sums = (
        cells.withColumn("_t", F.sum("n").over(W.partitionBy("truth")))
        .withColumn("_c", F.sum("n").over(W.partitionBy("cluster")))
        .agg(
            F.sum(n).alias("total"),
            F.countDistinct("truth").alias("categories"),
            F.countDistinct("cluster").alias("clusters"),
            F.sum(_pairs(n)).alias("both"),
            F.sum(n * (t - 1.0) / 2.0).alias("in_truth"),
            F.sum(n * (c - 1.0) / 2.0).alias("in_cluster"),
            F.sum(n * F.ln(n)).alias("ln_cell"),
            F.sum(n * F.ln(t)).alias("ln_truth"),
            F.sum(n * F.ln(c)).alias("ln_cluster"),
        )
    )
    expected = F.col("in_truth") * F.col("in_cluster") / _pairs(total)
    middle = (F.col("in_truth") + F.col("in_cluster")) / 2.0
    same = (F.col("in_truth") == F.col("both")) & (F.col("in_cluster") == F.col("both"))
    h_truth = F.ln(total) - F.col("ln_truth") / total
    h_cluster = F.ln(total) - F.col("ln_cluster") / total
    mutual = F.ln(total) + (F.col("ln_cell") - F.col("ln_truth") - F.col("ln_cluster")) / total
    one_each = (F.col("categories") == 1) & (F.col("clusters") == 1)
    one_side = (F.col("categories") == 1) | (F.col("clusters") == 1)
    return sums.select(
        total.cast("bigint").alias("rows"), "categories", "clusters",
        F.when(same, 1.0).otherwise((F.col("both") - expected) / (middle - expected)).alias("ari"),
        F.when(one_each, 1.0).when(one_side | (mutual <= 1e-12), 0.0)
        .otherwise(mutual / ((h_truth + h_cluster) / 2.0)).alias("nmi"),
    )


def cluster_profile(cells: DataFrame) -> DataFrame:
    """What each cluster holds: size, categories, the largest one and its (rounded) share."""
    share = round_even(F.col("_top") / F.col("size"), 3)
    return (
        cells.groupBy("cluster").agg(
            F.sum("n").alias("size"), F.count(F.lit(1)).alias("distinct_true_categories"),
            F.max("n").alias("_top"),
            F.min_by("truth", F.struct(-F.col("n"), "truth")).alias("dominant_category"),
        )
        .select(
            "cluster", "size", "distinct_true_categories", share.alias("purity"),
            "dominant_category", share.alias("dominant_category_share"),
        )
    )


def worst_first(profile: DataFrame) -> DataFrame:
    return profile.orderBy("purity", "cluster")


def mean_purity(profile: DataFrame) -> DataFrame:
    """Mean of the rounded purities, plain and weighted by cluster size."""
    return profile.agg(
        F.avg("purity").alias("mean_purity"),
        (F.sum(F.col("purity") * F.col("size")) / F.sum("size")).alias("weighted_purity"),
        F.count(F.lit(1)).alias("clusters"),
    )


def diversity_threshold(categories: Column, clusters: Column) -> Column:
    """Categories from which a cluster counts as diffuse: twice the even share, at least five."""
    even = F.rint(2.0 * categories / clusters)
    return F.greatest(F.lit(float(fv.JUNK_MIN_CATEGORIES)), even).cast("int")


def junk_drawers(cells: DataFrame) -> DataFrame:
    """Clusters that are unusually diffuse and impure.  Pass a stored table: it is read twice."""
    limit = cells.agg(
        diversity_threshold(F.countDistinct("truth"), F.countDistinct("cluster")).alias("limit")
    )
    return cluster_profile(cells).filter(
        (F.col("distinct_true_categories") >= limit.scalar()) & (F.col("purity") < fv.JUNK_MAX_PURITY)
    )


def coverage(cells: DataFrame, minimum: int = fv.MIN_CATEGORY_SUPPORT) -> DataFrame:
    """Categories and rows in total, scored and left out for lack of support."""
    sizes = cells.groupBy("truth").agg(F.sum("n").alias("n"))
    scored = F.col("n") >= minimum
    return sizes.agg(
        F.count(F.lit(1)).alias("n_categories_total"),
        F.count_if(scored).alias("n_categories_scored"),
        F.count_if(~scored).alias("n_categories_excluded"),
        F.sum("n").alias("n_rows_total"),
        F.coalesce(F.sum(F.when(scored, F.col("n"))), F.lit(0)).alias("n_rows_scored"),
        F.coalesce(F.sum(F.when(~scored, F.col("n"))), F.lit(0)).alias("n_rows_excluded"),
    ).withColumn("reliable", F.col("n_rows_scored") >= fv.RELIABLE_ROWS)
