"""k-means whose labels do not depend on how the rows are stored.

Unit vectors are taken as whole numbers of steps of 2^-20, so sums of vectors and squared distances are
exact whatever the order of rows and partitions.  Centres start from rows drawn by a hash of their key.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from themescope import fixed_values as fv
from themescope.functions.vectors import FEATURES, as_matrix
from themescope.operators.guards import need_more_rows_than
from themescope.session import scratch_path

STEP = 1 << 20
#: Rows drawn by hash for each cluster, among which the first centres of all starts are chosen.
DRAWN_PER_CLUSTER = 25
_SUMS = "start int, cluster int, dim int, total long, n long"


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the length of the points; whole numbers below 2^53 for up to 4,000 dimensions."""
    return (centres * centres).sum(axis=1) - 2.0 * (x @ centres.T)


def first_centres(drawn: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the drawn vectors, each chosen with a chance that grows with its distance from those before it."""
    draw = random.Random(seed)
    chosen = [draw.randrange(len(drawn))]
    far = np.full(len(drawn), np.inf)
    while len(chosen) < k:
        far = np.minimum(far, ((drawn - drawn[chosen[-1]]) ** 2).sum(axis=1))
        upto = np.cumsum(far)
        at = int(np.searchsorted(upto, draw.random() * upto[-1], side="right"))
        chosen.append(min(at, len(drawn) - 1))
    return drawn[chosen]


def stable_kmeans(
    unit: DataFrame, key: str, k: int, starts: int = fv.KMEANS_STARTS, seed: int = fv.SEED, max_iter: int = 100,
) -> tuple[DataFrame, float]:
    """``(key, cluster_id)`` of the cheapest of several starts over ``features``, and its cost.

    All starts advance in the same pass over the stored vectors; a pass returns k x dimensions sums for each
    start, which is all the driver sees.  Equal distances go to the smaller number; of equally cheap starts
    the first is taken; an empty cluster keeps its centre.
    """
    spark = unit.sparkSession
    steps = F.transform(vector_to_array(F.col(FEATURES)), lambda x: F.round(x * float(STEP)))
    path = scratch_path(spark, "kmeans-vectors")
    unit.select(key, steps.alias("v")).write.parquet(path)
    points = spark.read.parquet(path)
    need_more_rows_than(points.count(), k)
    drawn = points.orderBy(F.xxhash64(F.lit(seed), key), key).limit(DRAWN_PER_CLUSTER * k).select("v").collect()
    pool = np.array([r.v for r in drawn])
    centres = np.stack([first_centres(pool, k, seed + start) for start in range(starts)])
    dims = pool.shape[1]

    def sums_under(current: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((starts, k, dims + 1), np.int64)  # the last column adds up the cost
            counts = np.zeros((starts, k), np.int64)
            for batch in batches:
                x = as_matrix(batch.column("v"))
                if not len(x):
                    continue
                whole, lengths = x.astype(np.int64), (x * x).sum(axis=1).astype(np.int64)
                for start in range(starts):
                    squares = _squares(x, current[start])
                    near = squares.argmin(axis=1)
                    cost = squares[np.arange(len(x)), near].astype(np.int64) + lengths
                    for c in np.unique(near):
                        own = near == c
                        counts[start, c] += own.sum()
                        total[start, c, :dims] += whole[own].sum(axis=0)
                        # in steps of 2^-20 of a squared unit, so that sums of any table fit
                        total[start, c, dims] += (cost[own] >> 20).sum()
            place = np.indices(total.shape).reshape(3, -1)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(p, pa.int32()) for p in place], pa.array(total.reshape(-1)),
                 pa.array(np.repeat(counts.reshape(-1), dims + 1))], names=["start", "cluster", "dim", "total", "n"])

        return run

    for turn in range(max_iter + 1):
        found = points.select("v").mapInArrow(sums_under(centres.copy()), _SUMS).groupBy("start", "cluster", "dim").agg(
            F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        costs, moved = [0] * starts, centres.copy()
        for r in found:
            if r.dim == dims:
                costs[r.start] += r.total
            elif r.n:
                moved[r.start, r.cluster, r.dim] = (2 * r.total + r.n) // (2 * r.n)
        if turn == max_iter or (moved == centres).all():
            break  # the costs are those of these centres
        centres = moved
    best = min(range(starts), key=lambda s: (costs[s], s))
    chosen = centres[best]

    @F.arrow_udf("int")
    def nearest(vectors: pa.Array) -> pa.Array:
        x = as_matrix(vectors)
        return pa.array(_squares(x, chosen).argmin(axis=1) if len(x) else [], pa.int32())

    return points.select(key, nearest("v").alias("cluster_id")), costs[best] / STEP
