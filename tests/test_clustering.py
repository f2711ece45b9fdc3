"""Vectors, silhouettes and k-means."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from themescope.functions.vectors import normalise_vectors, with_unit_features
from themescope.operators import clustering as cl
from themescope.operators.k_selection import sweep_k

VECTORS = [
    (0, [1.0, 0.1], 0), (1, [1.0, 0.1], 0), (2, [0.9, 0.3], 0), (3, [0.1, 1.0], 1),
    (4, [0.2, 0.9], 1), (5, [-1.0, 0.0], 2), (6, [0.0, 0.0], 1), (7, [0.8, 0.9], 1),
]


def silhouettes_by_definition(rows):
    x = np.array([v for _, v, _ in rows])
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norms == 0, 1, norms)
    labels = np.array([c for _, _, c in rows])
    distance = 1 - x @ x.T
    np.fill_diagonal(distance, 0)
    out = []
    for i, c in enumerate(labels):
        mates = (labels == c).sum() - 1
        if mates == 0:
            out.append(0.0)
            continue
        a = distance[i, labels == c].sum() / mates
        b = min(distance[i, labels == o].mean() for o in set(labels) - {c})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return out


@pytest.fixture(scope="module")
def unit(spark):
    rows = spark.createDataFrame(VECTORS, "id int, embedding array<float>, label int")
    return with_unit_features(rows).persist()


def test_point_silhouettes(unit):
    got = [r.silhouette for r in cl.point_silhouettes(unit, "label").orderBy("id").collect()]
    assert got == pytest.approx(silhouettes_by_definition(VECTORS), abs=1e-6)


def test_single_cluster_has_no_silhouette(unit):
    one = unit.withColumn("label", F.lit(4))
    assert {r.silhouette for r in cl.point_silhouettes(one, "label").collect()} == {0.0}


def test_report_and_order(unit):
    scored = cl.point_silhouettes(unit, "label")
    report = {r.label: (r.n, r.negative) for r in cl.silhouette_report(scored, "label").collect()}
    assert {k: n for k, (n, _) in report.items()} == {0: 3, 1: 4, 2: 1}
    placed = cl.silhouette_order(scored, "label", "id").orderBy("position").collect()
    assert [r.position for r in placed] == [10, 11, 12, 23, 24, 25, 26, 37]
    assert [r.label for r in placed] == sorted(r.label for r in placed)


def test_zero_vector_stays_zero(spark):
    rows = spark.createDataFrame(VECTORS, "id int, embedding array<float>, label int")
    got = {r.id: r.embedding for r in normalise_vectors(rows).collect()}
    assert got[6] == [0.0, 0.0]
    assert sum(v * v for v in got[2]) == pytest.approx(1.0)


def test_ties_go_to_the_lower_centroid(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0])], "id int, embedding array<float>")
    centres = spark.createDataFrame([(7, [1.0, 0.0]), (3, [-1.0, 0.0]), (9, [1.0, 0.0])], "centroid_id long, embedding array<float>")
    got = cl.assign_to_centroids(points, centres).orderBy("id").collect()
    assert [(r.cluster_id, r.square_distance) for r in got] == [(3, 1.0), (7, 1.0)]


def test_blocks_of_clusters_change_nothing(unit, spark, monkeypatch):
    """One, two or all clusters per block, and slices of single points."""
    whole = {tuple(r) for r in cl.point_silhouettes(unit, "label").select("id", F.round("silhouette", 9)).collect()}
    for values in (2, 4, 1000):
        monkeypatch.setattr(cl, "BLOCK_VALUES", values)
        monkeypatch.setattr(cl, "SLICE_PAIRS", 1)
        got = cl.point_silhouettes(unit, "label").select("id", F.round("silhouette", 9))
        assert {tuple(r) for r in got.collect()} == whole
    draw = random.Random(8)
    points = spark.createDataFrame([(i, [draw.randrange(9) * 1.0, draw.randrange(9) * 1.0]) for i in range(300)], "id int, embedding array<double>")
    centres = spark.createDataFrame([(i, [draw.randrange(9) * 1.0, draw.randrange(9) * 1.0]) for i in range(40)], "centroid_id long, embedding array<double>")
    held = [(r.centroid_id, r.embedding) for r in centres.collect()]
    for values in (2, 14, 1000):
        monkeypatch.setattr(cl, "BLOCK_VALUES", values)
        for r in cl.assign_to_centroids(points, centres).collect():
            want = min((sum((a - b) ** 2 for a, b in zip(r.embedding, c)), i) for i, c in held)
            assert (r.square_distance, r.cluster_id) == want


def test_fifty_thousand_clusters(spark):
    """10,000 clusters of two equal points and 40,000 of one."""
    points = spark.range(60_000).selectExpr(
        "id", "CAST(id % 50000 AS INT) AS cluster_id",
        "array(cos(id % 50000), sin(id % 50000), cos(2 * (id % 50000))) AS embedding").repartition(8)
    scored = cl.point_silhouettes(with_unit_features(points), "cluster_id")
    report = scored.agg(F.count(F.lit(1)).alias("n"), F.min("silhouette").alias("low"), F.countDistinct("cluster_id").alias("k")).first()
    assert (report.n, report.k) == (60_000, 50_000) and report.low > -0.01


@pytest.fixture(scope="module")
def embeddings(spark, small):
    return with_unit_features(spark.read.parquet(f"{small}/embeddings.parquet")).select("vec_id", "label", "features").persist()


def test_kmeans(embeddings):
    labels = cl.kmeans_labels(embeddings, 5, starts=3, max_iter=10)
    rows = labels.select("vec_id", "cluster_id").collect()
    assert len({r.vec_id for r in rows}) == len(rows) == embeddings.count()
    assert {r.cluster_id for r in rows} <= set(range(5))
    best = cl.best_kmeans(embeddings, 5, starts=3, max_iter=10).summary.trainingCost
    first = cl.best_kmeans(embeddings, 5, starts=1, max_iter=10).summary.trainingCost
    assert best <= first
    own = cl.inertia(labels, "cluster_id").agg(F.sum("inertia").alias("x")).first().x
    assert own == pytest.approx(best, rel=1e-2)
    with pytest.raises(ValueError):
        cl.kmeans_labels(embeddings.limit(5), 5)


def test_sweep(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    table = sweep_k(vectors, "label", [2, 4, 100_000], starts=1, max_iter=5).orderBy("k").collect()
    assert [r.k for r in table] == [2, 4]
    assert table[1].inertia < table[0].inertia


def test_stable_labels_on_any_partitions(spark, embeddings):
    from themescope.operators.stable_clusters import stable_kmeans

    unit = embeddings.select("vec_id", "features")
    runs = []
    for parts in (1, 4, 7):
        labels, cost = stable_kmeans(unit.repartition(parts), "vec_id", 6, starts=3, max_iter=15)
        runs.append((cost, {r.vec_id: r.cluster_id for r in labels.collect()}))
    assert runs[0] == runs[1] == runs[2]
    cost, labels = runs[0]
    assert set(labels.values()) <= set(range(6)) and len(labels) == unit.count()
    model = cl.best_kmeans(unit, 6, starts=3, max_iter=15)
    assert cost <= 1.1 * model.summary.trainingCost
    with pytest.raises(ValueError):
        stable_kmeans(unit.limit(5), "vec_id", 6)


def test_a_sweep_takes_no_more_tasks_for_more_partitions(spark, monkeypatch):
    from themescope.operators import k_selection

    seen = []
    fit = k_selection.best_kmeans
    monkeypatch.setattr(k_selection, "best_kmeans", lambda unit, k, **o: (
        seen.append(unit.rdd.getNumPartitions()), fit(unit, k, **o))[1])
    rows = spark.range(300).select(
        F.array((F.col("id") % 3).cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
        (F.col("id") % 3).cast("string").alias("truth")).repartition(200)
    table = k_selection.sweep_k(rows, "truth", [3], starts=1, max_iter=5).collect()
    assert seen == [4 * spark.sparkContext.defaultParallelism] and table[0].ari == 1.0
