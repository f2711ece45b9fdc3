"""Centroid clustering of integer vectors with a table of distances to fixed pivots (LAESA).

Every vector's distances to a few fixed pivots are computed and stored once.  In each round a centroid's
distances to the same pivots are known as well, and the difference of the two bounds the distance of vector
and centroid from below.  Centroids are tried in order of that bound; one whose bound exceeds the best distance
so far is never computed.  Distances that are computed are exact integers, so the pivots decide the cost only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themescope.llm.common import stored

SCALE, DIMS, CLUSTERS, ROUNDS = 64, 64, 16, 3
PIVOTS = 8
#: Vectors among which pivots are chosen, far from each other.
PIVOT_POOL = 256
#: Components are clamped to this magnitude (x about 2 million), so every squared distance fits a long.
LARGEST = 1 << 27
#: Share of two pivot distances by which their difference may be off through rounding, with a wide margin.
_SLACK = 1e-12


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row against one point each."""
    gap = rows - points
    return np.einsum("ij,ij->i", gap, gap)


def pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), len(pivots)))
    for j, pivot in enumerate(pivots):
        out[:, j] = np.sqrt(_distances(rows, pivot[None, :]).astype(np.float64))
    return out


def nearest(rows: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray):
    """Number of the nearest centroid of each row (the smaller of equals), its squared distance, and how many
    distances were computed for it.  ``table`` holds the rows' distances to the pivots."""
    n, k = len(rows), len(centroids)
    own = pivot_distances(centroids, pivots)
    bound = np.zeros((n, k))
    for j in range(len(pivots)):
        a, b = table[:, j, None], own[None, :, j]
        np.maximum(bound, np.abs(a - b) - _SLACK * (a + b), out=bound)
    np.square(bound, out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(n, np.iinfo(np.int64).max)
    cluster = np.full(n, k, np.int64)
    computed = np.zeros(n, np.int64)
    for turn in range(k):
        number = order[:, turn]
        open_rows = np.flatnonzero(bound[np.arange(n), number] <= best)
        if not len(open_rows):
            break
        number = number[open_rows]
        distance = _distances(rows[open_rows], centroids[number])
        computed[open_rows] += 1
        had, by = best[open_rows], cluster[open_rows]
        better = (distance < had) | ((distance == had) & (number < by))
        best[open_rows] = np.where(better, distance, had)
        cluster[open_rows] = np.where(better, number, by)
    return cluster, best, computed


def choose_pivots(pool: np.ndarray, count: int) -> np.ndarray:
    """Members of ``pool``, each with the largest sum of distances to those chosen before it."""
    if not len(pool):
        return pool
    chosen, total = [0], np.zeros(len(pool))
    while len(chosen) < min(count, len(pool)):
        total += np.sqrt(_distances(pool, pool[chosen[-1]][None, :]).astype(np.float64))
        total[chosen] = -1.0
        chosen.append(int(np.argmax(total)))
    return pool[chosen]


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """id and ``q``: floor(scale * x) of vectors with ``dims`` components, none missing or non-finite."""
    v = F.col(vector_col)
    usable = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    step = F.transform(v, lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(
        F.lit(float(LARGEST)), F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))).cast("int"))
    return (vectors.filter(F.coalesce(usable, F.lit(False)))
            .select(F.col(id_col).alias("id"), step.alias("q")))


def _matrix(column: pa.Array, dims: int, dtype) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype).reshape(len(column), dims)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), kind))


def pivot_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS,
                   rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "1",
                   pivots: int = PIVOTS) -> DataFrame:
    """One row per usable vector: id_col, cluster, distance (squared), cluster_inertia, inertia,
    centroid_sha256, exact_distances (centroids whose distance was computed in the last assignment).

    The k vectors with the smallest SHA-256 of ``seed:id`` are the first centroids; equal hashes (repeated
    ids) are ordered by id and vector, a missing id comes last.  With fewer than k usable vectors each is a
    centroid.  Centroid components are floor(sum / count), exactly; an empty cluster keeps its centroid; of
    equally near centroids the smaller number is taken.  Vectors of another length, and those with a missing
    or non-finite component, are left out.  Repeated rows count each time, other columns are ignored; no
    usable vector gives an empty table.

    Vectors and their pivot distances are stored once.  A round is one narrow pass whose tasks return k * dims
    sums each; the driver holds k * dims numbers and at most PIVOT_POOL + k vectors.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    base = quantised(vectors, id_col, vector_col, dims, scale)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = (base.withColumn("h", hashed).orderBy(F.col("h").asc_nulls_last(), "id", "q")
             .limit(k + PIVOT_POOL).select("q").collect())
    out = (f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, "
           "centroid_sha256 string, exact_distances int")
    if not first:
        return spark.createDataFrame([], out)
    pool = np.array([r.q for r in first], np.int64)
    centroids, fixed = pool[:k].copy(), choose_pivots(pool[k:] if len(pool) > k else pool, pivots)

    def measure(batches):
        for batch in batches:
            rows = _matrix(batch.column("q"), dims, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("q"), _lists(pivot_distances(rows, fixed), pa.float64())],
                names=["id", "q", "to_pivots"])

    table = stored(base.mapInArrow(measure, f"id {kind}, q array<int>, to_pivots array<double>"), "pivot-table")

    def assigned(batch, centres):
        rows = _matrix(batch.column("q"), dims, np.int64)
        return rows, *nearest(rows, _matrix(batch.column("to_pivots"), len(fixed), np.float64), centres, fixed)

    def sums_under(centres):
        def run(batches):
            sums, counts = np.zeros((len(centres), dims), np.int64), np.zeros(len(centres), np.int64)
            for batch in batches:
                rows, cluster, _, _ = assigned(batch, centres)
                counts += np.bincount(cluster, minlength=len(centres))
                order = np.argsort(cluster, kind="stable")
                held, at = np.unique(cluster[order], return_index=True)
                if len(held):
                    sums[held] += np.add.reduceat(rows[order], at, axis=0)
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(full, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(full)), pa.int32()),
                 pa.array(sums[full].reshape(-1), pa.int64()), pa.array(np.repeat(counts[full], dims), pa.int64())],
                names=["cluster", "dim", "total", "n"])

        return run

    for _ in range(rounds):
        rows = (table.mapInArrow(sums_under(centroids.copy()), "cluster int, dim int, total long, n long")
                .groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
                                               F.sum("n").alias("n")).collect())
        for r in rows:
            centroids[r.cluster, r.dim] = int(r.total) // r.n

    last = centroids.copy()

    def settle(batches):
        for batch in batches:
            _, cluster, distance, computed = assigned(batch, last)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()),
                 pa.array(computed, pa.int32())], names=["id", "cluster", "distance", "exact_distances"])

    final = stored(table.mapInArrow(settle, f"id {kind}, cluster int, distance long, exact_distances int"),
                   "pivot-clusters")
    inertia = dict(final.groupBy("cluster").agg(F.sum("distance")).collect())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last.tolist()]
    names = spark.createDataFrame(
        [(c, total, sum(inertia.values()), digests[c]) for c, total in sorted(inertia.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per cluster, k at most.
    return final.join(F.broadcast(names), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
        "exact_distances")
