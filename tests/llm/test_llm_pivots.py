"""Clustering with a pivot table against a plain computation."""

import hashlib
import math
import random

import numpy as np
import pytest

from themescope.llm import pivot_clusters as pc


def brute(rows, k=16, rounds=3, dims=64):
    """Every distance, with Python integers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in hashed[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if own:
                centres[n] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    out = []
    for (i, _), (d, c) in zip(kept, found):
        out.append((i, c, d, sum(x for x, y in found if y == c), sum(x for x, _ in found),
                    hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.fixture()
def rows():
    draw = random.Random(11)
    far = [[draw.uniform(-4, 4) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + draw.gauss(0, 0.4) for x in far[i % 5]]) for i in range(180)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[7][1]), (-9, rows[8][1])]  # repeated and missing ids
    rows += [(500, [0.0] * 64), (501, [0.0] * 64), (502, [-0.001] * 64)]  # ties and floors below zero
    rows += [(600, [1.0] * 63), (601, []), (602, None), (603, [1.0] * 63 + [None]),
             (604, [float("nan")] + [1.0] * 63), (605, [1.0] * 63 + [float("-inf")])]
    return rows


@pytest.mark.parametrize("kind", ["double", "float"])
def test_equals_brute_force(spark, rows, kind):
    if kind == "float":
        rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    table = spark.createDataFrame([(i, v, "a", 1) for i, v in rows],
                                  f"vec_id long, embedding array<{kind}>, q string, cluster int").repartition(4)
    got = pc.pivot_clusters(table)
    assert order(tuple(r)[:6] for r in got.collect()) == order(brute(rows))
    assert got.agg({"exact_distances": "avg"}).first()[0] < 16  # pivots spare distances


def test_few_rows_and_none(spark):
    few = [(i, [float(i % 2)] * 64) for i in range(5)]
    table = spark.createDataFrame(few, "vec_id int, embedding array<double>")
    assert order(tuple(r)[:6] for r in pc.pivot_clusters(table).collect()) == order(brute(few))
    none = pc.pivot_clusters(table.limit(0))
    assert none.collect() == [] and none.columns[:3] == ["vec_id", "cluster", "distance"]
    assert pc.pivot_clusters(table.selectExpr("vec_id", "slice(embedding, 1, 3) AS embedding")).collect() == []


def test_bounds_never_drop_the_nearest():
    draw = np.random.default_rng(4)
    for spread in (1, 50, 1 << 20, pc.LARGEST):
        rows = draw.integers(-spread, spread + 1, (300, 8))
        centres = np.concatenate([rows[:6], rows[:6], draw.integers(-spread, spread + 1, (4, 8))])
        pivots = pc.choose_pivots(rows[10:60], 4)
        cluster, best, _ = pc.nearest(rows, pc.pivot_distances(rows, pivots), centres, pivots)
        every = ((rows[:, None, :].astype(object) - centres[None, :, :]) ** 2).sum(2)
        assert [int(c) for c in cluster] == [min(range(16), key=lambda c: (r[c], c)) for r in every]
        assert best.tolist() == every.min(1).tolist()


def test_huge_components_are_clamped(spark):
    table = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)],
                                  "vec_id long, embedding array<double>")
    got = {r.vec_id: r.distance for r in pc.pivot_clusters(table, k=1, rounds=0).collect()}
    assert max(got.values()) <= 64 * (2 * pc.LARGEST) ** 2 and min(got.values()) == 0
