"""Agreement scores: known values, invariances, and the profile rules."""

import math
from collections import Counter

import pytest

from themescope.operators import contingency as ct
from themescope.operators.guards import need_more_rows_than, need_rows, usable_ks
from themescope.operators.k_selection import choose_k, elbow
from themescope.plans.evaluate import evaluate_clusters
from themescope.schemas import K_SWEEP


def cells(spark, pairs):
    return ct.contingency(spark.createDataFrame(pairs, "t string, c int"), "t", "c")


def score(spark, pairs):
    row = ct.agreement(cells(spark, pairs)).first()
    return row.ari, row.nmi


def by_definition(pairs):
    n, a, b = Counter(pairs), Counter(t for t, _ in pairs), Counter(c for _, c in pairs)
    total = len(pairs)
    both, pa, pb = (sum(math.comb(v, 2) for v in x.values()) for x in (n, a, b))
    expected = pa * pb / math.comb(total, 2)
    mi = sum(v / total * math.log(v * total / (a[t] * b[c])) for (t, c), v in n.items())
    entropy = [-sum(v / total * math.log(v / total) for v in x.values()) for x in (a, b)]
    return (both - expected) / ((pa + pb) / 2 - expected), mi / (sum(entropy) / 2)


PAIRS = [(f"t{i * i % 5}", i % 4) for i in range(60)] + [("t9", 3)]


def test_scores_by_definition(spark):
    assert score(spark, PAIRS) == pytest.approx(by_definition(PAIRS), abs=1e-12)


def test_label_names_do_not_matter(spark):
    moved = [(t, {0: 7, 1: 3, 2: 0, 3: 1}[c]) for t, c in PAIRS]
    assert score(spark, moved) == pytest.approx(score(spark, PAIRS), abs=1e-12)


@pytest.mark.parametrize("pairs,ari,nmi", [
    ([("a", 0), ("a", 0), ("b", 1), ("b", 1)], 1.0, 1.0),
    ([("a", 1), ("a", 1), ("b", 0), ("b", 0)], 1.0, 1.0),
    ([("a", 0), ("b", 0), ("c", 0)], 0.0, 0.0),
    ([("a", 0), ("a", 0)], 1.0, 1.0),
    ([("a", 0), ("b", 1), ("c", 2)], 1.0, 1.0),
    ([("a", 0), ("a", 1), ("b", 0), ("b", 1)], -0.5, 0.0),
])
def test_limits(spark, pairs, ari, nmi):
    assert score(spark, pairs) == pytest.approx((ari, nmi), abs=1e-12)


def test_null_truth_is_not_scored(spark):
    assert ct.agreement(cells(spark, [*PAIRS, (None, 1)])).first().rows == len(PAIRS)


def test_support(spark):
    pairs = [("nine", 0)] * 9 + [("ten", 0)] * 10 + [("eleven", 1)] * 11
    assert {r.truth for r in ct.supported(cells(spark, pairs)).collect()} == {"ten", "eleven"}
    row = ct.coverage(cells(spark, pairs)).first()
    assert (row.n_categories_excluded, row.n_rows_scored, row.n_rows_total, row.reliable) == (1, 21, 30, False)


def test_profile(spark):
    pairs = [("b", 0)] * 2 + [("a", 0)] * 2 + [("c", 0)] + [("a", 1)] * 3
    got = {r.cluster: (r.size, r.distinct_true_categories, r.purity, r.dominant_category)
           for r in ct.cluster_profile(cells(spark, pairs)).collect()}
    assert got == {0: (5, 3, 0.4, "a"), 1: (3, 1, 1.0, "a")}


def test_purity_is_rounded_before_the_junk_rule(spark):
    # 749 of 2500 is 0.2996: rounds to 0.3, so the cluster is not flagged; 748 of 2500 is.
    def pairs(top):
        rest = 2500 - top
        return [("t0", 0)] * top + [(f"t{1 + i % 9}", 0) for i in range(rest)]

    assert ct.junk_drawers(cells(spark, pairs(749)).limit(0).unionByName(cells(spark, pairs(749)))).count() == 0
    flagged = ct.junk_drawers(cells(spark, pairs(748) + [(f"t{i}", 1 + i) for i in range(10)]))
    assert [r.cluster for r in flagged.collect()] == [0]


@pytest.mark.parametrize("categories,clusters,limit", [(13, 4, 6), (15, 4, 8), (4, 4, 5), (54, 12, 9)])
def test_diversity_threshold(spark, categories, clusters, limit):
    from pyspark.sql import functions as F

    row = spark.range(1).select(ct.diversity_threshold(F.lit(categories), F.lit(clusters)).alias("x")).first()
    assert row.x == limit


def test_evaluation_joins_and_guards(spark):
    clusters = spark.createDataFrame([(i, i % 2, "old") for i in range(40)], "complaint_id long, cluster_id int, Issue string")
    truth = spark.createDataFrame([(i, f"i{i % 2}") for i in range(30)], "complaint_id long, Issue string")
    result = evaluate_clusters(clusters, truth)
    row = result.summary.first()
    assert (row.n_rows_total, row.ari, row.nmi, row.mean_purity) == (30, 1.0, 1.0, 1.0)
    assert [r.cluster for r in result.breakdown.collect()] == [0, 1] and result.junk.count() == 0
    with pytest.raises(ValueError, match="no complaint id"):
        evaluate_clusters(clusters, truth.limit(0))


def test_guards(spark):
    with pytest.raises(ValueError):
        need_more_rows_than(12, 12)
    with pytest.raises(ValueError):
        need_more_rows_than(5, 0)
    assert usable_ks([2, 5, 9], 9) == [2, 5]
    with pytest.raises(ValueError):
        need_rows(spark.range(0), "empty")


def sweep(spark, rows):
    return spark.createDataFrame([(k, s, a, 0.0, i) for k, s, a, i in rows], K_SWEEP)


def test_elbow(spark):
    rows = [(2, .1, .1, 100.), (3, .2, .3, 40.), (4, .1, .3, 30.), (5, .0, .2, 25.)]
    chosen = choose_k(sweep(spark, rows)).first()
    assert (chosen.k_elbow, chosen.k_ari, chosen.k_silhouette, chosen.disagree) == (3, 3, 3, False)
    assert chosen.ari_at_k_elbow == 0.3


def test_elbow_without_bend(spark):
    line = [(2, .1, .1, 30.), (3, .1, .1, 20.), (4, .1, .1, 10.)]
    assert [round(r.distance, 9) for r in elbow(sweep(spark, line)).collect()] == [0, 0, 0]
    flat = [(2, .1, .1, 5.), (3, .1, .2, 5.)]
    assert [r.distance for r in elbow(sweep(spark, flat)).collect()] == [None, None]
    single = choose_k(sweep(spark, [(4, .1, .1, 5.)])).first()
    assert (single.k_ari, single.k_elbow) == (4, None)
