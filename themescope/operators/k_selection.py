"""Sweep over the number of clusters, and the choice of k from its table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from themescope import fixed_values as fv
from themescope.functions.numbers import round_even
from themescope.functions.vectors import with_unit_features
from themescope.operators.clustering import best_kmeans, mean_silhouette
from themescope.operators.contingency import agreement, supported
from themescope.operators.guards import usable_ks
from themescope.schemas import K_SWEEP
from themescope.session import scratch_path

#: Partitions of the vectors a sweep reads in each pass, per core, at most.
TASKS_PER_CORE = 4


def sweep_k(
    vectors: DataFrame, truth: str, ks: list[int], minimum: int = fv.MIN_CATEGORY_SUPPORT,
    vector: str = "embedding", starts: int = fv.KMEANS_STARTS, seed: int = fv.SEED,
    max_iter: int = 100,
) -> DataFrame:
    """Silhouette, ARI, NMI and inertia for each k.

    ``vectors`` carries the true label (NULL where unknown).  All rows are clustered; only rows
    of categories with enough support are scored, the same ones for every k.
    """
    unit = with_unit_features(vectors.select(vector, truth), vector).select("features", truth)
    # Every task of every pass reports to the driver, so the number of tasks follows the cores, not the rows.
    unit = unit.coalesce(TASKS_PER_CORE * unit.sparkSession.sparkContext.defaultParallelism)
    unit = unit.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = {k: best_kmeans(unit, k, starts=starts, seed=seed, max_iter=max_iter)
                  for k in usable_ks(ks, unit.count())}
        cells = cells_by_k(unit, truth, models)
        rows = []
        for k, model in models.items():
            score = agreement(supported(cells.filter(F.col("k") == k).drop("k"), minimum)).first()
            silhouette = mean_silhouette(model.transform(unit)) if k > 1 else None
            rows.append((k, silhouette, score.ari, score.nmi, float(model.summary.trainingCost)))
    finally:
        unit.unpersist()
    table = vectors.sparkSession.createDataFrame(rows, K_SWEEP)
    return table.select(
        "k", *[round_even(F.col(c), 4).alias(c) for c in ("silhouette", "ari", "nmi")],
        round_even(F.col("inertia"), 2).alias("inertia"),
    )


def cells_by_k(unit: DataFrame, truth: str, models: dict[int, KMeansModel]) -> DataFrame:
    """Rows per k, true category and cluster, stored: one scan assigns each row under all models."""
    assigned = unit.filter(F.col(truth).isNotNull())
    for k, model in models.items():
        assigned = model.copy().setPredictionCol(f"_c{k}").transform(assigned)
    found = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_c{k}").alias("cluster")) for k in models])
    counted = (
        assigned.select(F.col(truth).alias("truth"), F.explode(found).alias("_a"))
        .groupBy("_a.k", "truth", "_a.cluster").agg(F.count(F.lit(1)).alias("n"))
    )
    path = scratch_path(unit.sparkSession, "cells-by-k")
    counted.write.parquet(path)
    return unit.sparkSession.read.schema(counted.schema).parquet(path)


def elbow(sweep: DataFrame, k: str = "k", value: str = "inertia") -> DataFrame:
    """Distance of every k from the chord between the curve's end points, both axes scaled to
    [0, 1].  NULL where an axis has no extent.

    The window spans the whole table, which holds one row per k.
    """
    whole = W.partitionBy(F.lit(0))

    def scaled(column: Column) -> Column:
        low, high = F.min(column).over(whole), F.max(column).over(whole)
        return F.when(high > low, (column - low) / (high - low))

    ends = whole.orderBy(k).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    unit = sweep.withColumn("_x", scaled(F.col(k).cast("double"))).withColumn(
        "_y", scaled(F.col(value).cast("double"))
    )
    # k runs from 0 to 1, so the chord starts at the first value and rises by the whole climb
    start, climb = F.first("_y").over(ends), F.last("_y").over(ends) - F.first("_y").over(ends)
    below = F.col("_y") - start - climb * F.col("_x")
    return unit.withColumn("distance", F.abs(below) / F.sqrt(1 + climb * climb)).select(*sweep.columns, "distance")


def choose_k(sweep: DataFrame) -> DataFrame:
    """Best k by agreement, by silhouette and by elbow, in one row; ties go to the smaller k."""
    def best(score: str) -> Column:
        return F.max_by("k", F.when(F.col(score).isNotNull(), F.struct(score, -F.col("k"))))

    chosen = elbow(sweep).agg(
        best("ari").alias("k_ari"), F.max("ari").alias("best_ari"),
        F.max_by("silhouette", F.struct("ari", -F.col("k"))).alias("silhouette_at_k_ari"),
        best("silhouette").alias("k_silhouette"), F.max("silhouette").alias("best_silhouette"),
        F.max_by("ari", F.when(F.col("silhouette").isNotNull(), F.struct("silhouette", -F.col("k")))).alias("ari_at_k_silhouette"),
        best("distance").alias("k_elbow"),
        F.max_by("ari", F.when(F.col("distance").isNotNull(), F.struct("distance", -F.col("k")))).alias("ari_at_k_elbow"),
    )
    return chosen.withColumn("disagree", F.col("k_ari") != F.col("k_silhouette"))
