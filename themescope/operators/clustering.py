"""k-means on unit vectors, and the geometry of any labelling.

Cluster geometry is derived from per-cluster vector sums (combined on the map side), so no pair
of points is ever formed: the cost is rows x clusters, in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from themescope import fixed_values as fv
from themescope.functions.vectors import FEATURES, as_matrix
from themescope.operators.guards import need_more_rows_than
from themescope.operators.small import small_side
from themescope.session import scratch_path

# Cluster tables of any size are taken in blocks of so many values (clusters x dimensions) at most, and a
# task compares a batch of points with a block in slices of so many pairs.
BLOCK_VALUES = 4_000_000
SLICE_PAIRS = 2_000_000


def best_kmeans(
    unit: DataFrame, k: int, starts: int = fv.KMEANS_STARTS, seed: int = fv.SEED,
    max_iter: int = 100, parallelism: int = 8,
) -> KMeansModel:
    """The cheapest of several k-means runs over ``features``.

    The vectors should be persisted: each start reads them several times.  Starts run side by
    side, so a small job of one start does not leave executors idle.
    """
    def fit(start: int) -> KMeansModel:
        return KMeans(
            k=k, seed=seed + start, maxIter=max_iter, featuresCol=FEATURES,
            predictionCol="cluster_id",
        ).fit(unit)

    with ThreadPoolExecutor(max(1, min(parallelism, starts))) as pool:
        models = list(pool.map(inheritable_thread_target(unit.sparkSession)(fit), range(starts)))
    return min(models, key=lambda m: m.summary.trainingCost)


def kmeans_labels(unit: DataFrame, k: int, **options: int) -> DataFrame:
    """Add ``cluster_id`` from the best of several starts; the vectors are held only while it is fitted."""
    held = unit.select(FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        need_more_rows_than(held.count(), k)
        model = best_kmeans(held, k, **options)
    finally:
        held.unpersist()
    return model.transform(unit)


def cluster_table(unit: DataFrame, cluster: str) -> DataFrame:
    """Per cluster: rows, vector sum and sum of squared lengths."""
    stats = Summarizer.metrics("sum", "normL2").summary(F.col(FEATURES))
    sums = (
        unit.groupBy(cluster).agg(stats.alias("s"), F.count(F.lit(1)).alias("n"))
        .select(cluster, "n", vector_to_array("s.sum").alias("vector_sum"),
                vector_to_array("s.normL2").alias("_norms"))
    )
    return sums.withColumn("square_sum", _square_length(F.col("_norms"))).drop("_norms")


def _square_length(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v * v)


def inertia(unit: DataFrame, cluster: str) -> DataFrame:
    """Squared distance of all points to the centre of their cluster, per cluster.

    Uses sum|x|^2 - |sum x|^2 / n, so no second pass over the points is needed.
    """
    spread = F.greatest(F.col("square_sum") - _square_length(F.col("vector_sum")) / F.col("n"), F.lit(0.0))
    return cluster_table(unit, cluster).select(cluster, "n", spread.alias("inertia"))


def _cluster_blocks(table: DataFrame, order: str, vector: str) -> Iterator[tuple[bool, pa.Table]]:
    """The rows of a cluster table in order, as blocks small enough for every task; True marks the last one.

    The driver holds one block at a time, however many clusters there are.
    """
    rows = table.filter(F.col(order).isNotNull())
    path = scratch_path(table.sparkSession, "clusters")
    rows.orderBy(order).write.parquet(path)
    kept = table.sparkSession.read.schema(rows.schema).parquet(path)
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("width")).first()
    per_block = max(1, BLOCK_VALUES // max(1, size.width or 1))
    if size.n <= per_block:
        yield True, kept.toArrow().sort_by(order)
        return
    held, seen = [], 0
    for row in kept.orderBy(order).toLocalIterator():
        held.append(row.asDict())
        seen += 1
        if len(held) == per_block or seen == size.n:
            yield seen == size.n, pa.Table.from_pylist(held)
            held = []


def _through_blocks(df: DataFrame, blocks: Iterator[tuple[bool, pa.Table]], step: Callable) -> DataFrame:
    """``df`` with the column ``_state`` after ``step(df, block)`` for each block.

    One block makes one lazy pass.  With more of them the points are stored between passes, so no task ever
    holds two blocks.
    """
    for last, block in blocks:
        df = step(df, block)
        if not last:
            path = scratch_path(df.sparkSession, "points")
            df.write.parquet(path)
            df = df.sparkSession.read.schema(df.schema).parquet(path)
    return df


def _slices(points: int, clusters: int) -> Iterator[slice]:
    step = max(1, SLICE_PAIRS // max(1, clusters))
    return (slice(at, min(at + step, points)) for at in range(0, points, step))


_SEEN = pa.struct([("near", pa.float64()), ("inner", pa.float64()), ("mates", pa.float64())])


def point_silhouettes(unit: DataFrame, cluster: str) -> DataFrame:
    """Add each point's cosine silhouette; 0 in a cluster of one.

    The mean distance to a cluster is 1 - x.S/n with S the sum of its unit vectors; in the
    point's own cluster the point itself is left out.  A point without a cluster scores 0.
    """
    def step(points: DataFrame, block: pa.Table) -> DataFrame:
        names = np.array(block.column(cluster).to_pylist())
        shared = unit.sparkSession.sparkContext.broadcast((
            names, np.asarray(block.column("n").to_pylist(), dtype=np.float64),
            as_matrix(block.column("vector_sum").combine_chunks()),
        ))

        @F.arrow_udf("struct<near double, inner double, mates double>")
        def seen(vectors: pa.Array, labels: pa.Array, before: pa.Array) -> pa.Array:
            clusters, sizes, sums = shared.value
            x = as_matrix(vectors)
            if not len(x):
                return pa.array([], type=_SEEN)
            near, inner, mates = (before.field(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(3))
            known = labels.is_valid().to_numpy(zero_copy_only=False)
            label = labels.fill_null(clusters[0].item()).to_numpy(zero_copy_only=False)
            own = np.minimum(np.searchsorted(clusters, label), len(clusters) - 1)
            here = known & (clusters[own] == label)
            for part in _slices(len(x), len(clusters)):
                dots = x[part] @ sums.T
                others = 1.0 - dots / sizes
                row, home = np.flatnonzero(here[part]), own[part][here[part]]
                others[row, home] = np.inf
                near[part] = np.fmin(near[part], others.min(axis=1))
                at = row + part.start
                mates[at] = sizes[home] - 1.0
                inner[at] = 1.0 - (dots[row, home] - (x[at] * x[at]).sum(axis=1)) / np.maximum(mates[at], 1.0)
            return pa.StructArray.from_arrays([pa.array(v) for v in (near, inner, mates)], fields=list(_SEEN))

        return points.withColumn("_state", seen(vector_to_array(F.col(FEATURES)), F.col(cluster), F.col("_state")))

    start = F.struct(*[F.lit(float("nan")).alias(f.name) for f in _SEEN]).alias("_state")
    points = _through_blocks(
        unit.select("*", start), _cluster_blocks(cluster_table(unit, cluster), cluster, "vector_sum"), step)
    near, inner, mates = (F.col(f"_state.{f.name}") for f in _SEEN)
    widest = F.greatest(inner, near)
    valid = ~F.isnan(mates) & (mates > 0) & (near < float("inf")) & (widest > 0)
    return points.withColumn("silhouette", F.when(valid, (near - inner) / widest).otherwise(0.0)).drop("_state")


def silhouette_report(scored: DataFrame, cluster: str) -> DataFrame:
    """Per cluster: points, mean silhouette and points with a negative one."""
    return scored.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("mean_silhouette"),
        F.count_if(F.col("silhouette") < 0).alias("negative"),
    )


def silhouette_order(scored: DataFrame, cluster: str, key: str, gap: int = 10) -> DataFrame:
    """Position of every point in a silhouette diagram: clusters stacked in order with a gap,
    points rising inside each.

    A point's place is the offset of its cluster plus the offset of its value range in the
    cluster plus its rank in that range, so a large cluster is ranked in many tasks.
    """
    def running(rows: str, *partition: str, by: str) -> Column:
        window = W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))
        return F.sum(rows).over(window.orderBy(by)) - F.col(rows)

    ranged = scored.withColumn("_range", F.floor((F.col("silhouette") + 1.0) * 500).cast("int"))
    ranges = ranged.groupBy(cluster, "_range").agg(F.count(F.lit(1)).alias("_n"))
    sizes = ranges.groupBy(cluster).agg((F.sum("_n") + gap).alias("_height"))
    base = sizes.withColumn("_base", running("_height", by=cluster) + gap).drop("_height")
    starts = (
        ranges.withColumn("_below", running("_n", cluster, by="_range"))
        .join(base, cluster)
        .select(cluster, "_range", (F.col("_base") + F.col("_below")).alias("_start"))
    )
    rank = F.row_number().over(W.partitionBy(cluster, "_range").orderBy("silhouette", key))
    return (
        ranged.join(small_side(starts), [cluster, "_range"])
        .withColumn("position", F.col("_start") + rank - 1)
        .select(key, cluster, "silhouette", "position")
    )


def mean_silhouette(labelled: DataFrame, cluster: str = "cluster_id") -> float:
    """Mean cosine silhouette of a labelling of unit vectors; zero vectors count as points like others."""
    return point_silhouettes(labelled, cluster).agg(F.avg("silhouette")).first()[0]


def assign_to_centroids(
    df: DataFrame, centroids: DataFrame, vector: str = "embedding", centroid_id: str = "centroid_id"
) -> DataFrame:
    """Add the id of the nearest centroid and the squared distance; ties go to the lower id."""
    kind = pa.struct([("id", pa.int64()), ("distance", pa.float64())])

    def step(points: DataFrame, block: pa.Table) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((
            np.asarray(block.column(centroid_id).to_pylist(), dtype=np.int64),
            as_matrix(block.column(vector).combine_chunks()),
        ))

        @F.arrow_udf("struct<id bigint, distance double>")
        def nearest(vectors: pa.Array, before: pa.Array) -> pa.Array:
            ids, centres = shared.value
            x = as_matrix(vectors)
            if not len(x):
                return pa.array([], type=kind)
            found = before.field(0).fill_null(-1).to_numpy(zero_copy_only=False).copy()
            distance = before.field(1).to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = (centres * centres).sum(axis=1)
            for part in _slices(len(x), len(centres)):
                best = (lengths - 2.0 * (x[part] @ centres.T)).argmin(axis=1)
                gaps = x[part] - centres[best]
                squares = (gaps * gaps).sum(axis=1)
                closer = squares < distance[part]  # blocks come in order of their ids
                found[part] = np.where(closer, ids[best], found[part])
                distance[part] = np.where(closer, squares, distance[part])
            return pa.StructArray.from_arrays([pa.array(found), pa.array(distance)], fields=list(kind))

        return points.withColumn("_state", nearest(F.col(vector), F.col("_state")))

    start = F.struct(F.lit(None).cast("bigint").alias("id"), F.lit(float("inf")).alias("distance")).alias("_state")
    blocks = _cluster_blocks(centroids.select(centroid_id, vector), centroid_id, vector)
    return (
        _through_blocks(df.select("*", start), blocks, step)
        .withColumn("cluster_id", F.col("_state.id"))
        .withColumn("square_distance", F.col("_state.distance"))
        .drop("_state")
    )
