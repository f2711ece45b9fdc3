"""Samples: exact sizes, whole small groups, same rows whatever the partitioning or skew."""

import pytest
from pyspark.sql import functions as F

from themescope.operators import preparation as prep, sampling as smp


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one category, a tiny category and rows without one."""
    kind = (
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, "tiny")
        .when(F.col("id") % 50 == 2, None).otherwise(F.concat(F.lit("c"), (F.col("id") % 7).cast("string")))
    )
    return spark.range(20_000).select(F.col("id").alias("complaint_id"), kind.alias("product")).persist()


def ids(df):
    return sorted(r.complaint_id for r in df.select("complaint_id").collect())


@pytest.mark.parametrize("cap,digits", [(1, 4), (100, 4), (100, 1), (1500, 2), (6667, 1), (50_000, 4)])
def test_cap_is_exact(skewed, cap, digits):
    sizes = {r["product"]: r["count"] for r in skewed.dropna().groupBy("product").count().collect()}
    got = {r["product"]: r["count"] for r in smp.cap_groups(skewed, "product", cap, digits=digits).groupBy("product").count().collect()}
    assert got == {k: min(n, cap) for k, n in sizes.items()}


def test_histogram_width_does_not_change_the_sample(skewed):
    assert ids(smp.cap_groups(skewed, "product", 90, digits=1)) == ids(smp.cap_groups(skewed, "product", 90, digits=4))


def test_same_sample_after_repartition(skewed):
    assert ids(smp.balanced_sample(skewed, target=500)) == ids(smp.balanced_sample(skewed.repartition(13), target=500))


@pytest.mark.parametrize("target", [3, 9, 500, 15_000, 100_000])
def test_balanced_sample_reaches_its_target(skewed, target):
    sample = smp.balanced_sample(skewed, target=target)
    got = ids(sample)
    known = skewed.dropna().count()
    groups = skewed.select("product").dropna().distinct().count()
    assert len(got) == len(set(got)) == min(max(target, groups), known)
    assert sample.filter("product = 'tiny'").count() == 1
    assert sample.filter("product is null").count() == 0


def test_first_draws_equal_a_sort_with_limit(skewed):
    from themescope.functions.draws import draw_hash

    sorted_rows = skewed.orderBy(draw_hash("complaint_id", "s"), "complaint_id").limit(700)
    assert ids(smp.first_draws(skewed, 700, seed="s")) == ids(sorted_rows)
    assert smp.first_draws(skewed, 50_000).count() == 20_000


def test_thinning(skewed):
    hot = prep.is_stratum(F.col("product"), "hot")
    assert smp.thin_stratum(skewed, hot, 1.0).count() == 20_000
    none = smp.thin_stratum(skewed, hot, 0.0)
    assert none.filter("product = 'hot'").count() == 0 and none.count() == 20_000 - 6667
    some = smp.thin_stratum(skewed, hot, 0.03).filter("product = 'hot'").count()
    assert 130 < some < 280


def test_holdout_is_whole_when_small(spark):
    rows = spark.range(5).withColumnRenamed("id", "complaint_id")
    assert ids(smp.holdout(rows)) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("limit, kind", [("10MB", "BroadcastHashJoin"), ("1KB", "SortMergeJoin")])
def test_small_side_is_broadcast_by_its_bytes(spark, limit, kind):
    from themescope.operators.small import small_side

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        joined = spark.range(10_000).join(small_side(spark.range(2_000)), "id")
        assert kind in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 2_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_without_a_key_do_not_shorten_a_sample(spark):
    rows = spark.createDataFrame([(i if i < 80 else None, "g") for i in range(100)], "complaint_id long, product string")
    assert smp.cap_groups(rows, "product", 50).count() == 50
