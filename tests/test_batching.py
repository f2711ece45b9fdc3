"""Dense numbers and next-fit batches against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from themescope.operators import batching, ordering


def next_fit(tokens, items, budget):
    batch, held, used, out = 0, 0, 0, []
    for t in tokens:
        if held >= items or (held and used + t > budget):
            batch, held, used = batch + 1, 0, 0
        held, used = held + 1, used + t
        out.append(batch)
    return out


def check(spark, tokens, items, budget, **options):
    rows = spark.createDataFrame([(i * 3, t) for i, t in enumerate(tokens)], "k long, t int").repartition(5)
    got = batching.pack_batches(rows, "k", "t", items, budget, **options).orderBy("k").collect()
    assert [r.batch for r in got] == next_fit(tokens, items, budget)
    assert [r.t for r in got] == tokens


@pytest.mark.parametrize("tokens", [
    [9000, 10, 10], [10, 9000, 10], [10, 10, 9000], [3000, 3000, 1], [1] * 101, [6000, 6000], [5],
])
def test_edges(spark, tokens):
    check(spark, tokens, 100, 6000)


@pytest.mark.parametrize("seed", range(3))
def test_many_blocks_and_levels(spark, seed):
    """Blocks and fan small enough that functions are composed over several levels."""
    draw = random.Random(seed)
    tokens = [draw.choice([1, 5, 20, 60, 150]) for _ in range(700)]
    check(spark, tokens, 7, 100, block_rows=11, fan=3)


def test_block_of_exactly_the_item_budget(spark):
    check(spark, [1] * 95, 10, 1000, block_rows=10, fan=2)
    with pytest.raises(ValueError):
        check(spark, [1], 10, 10, block_rows=9)


def test_dense_index(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("v"))
    got = ordering.dense_index(rows, "i", ["v"]).orderBy("i").collect()
    assert [(r.i, r.v) for r in got] == [(i, i) for i in range(1000)]


def test_made_up_ids(spark):
    rows = spark.range(0, 100, 1, 5).select(F.col("id").alias("n"))
    got = ordering.ensure_id(rows).collect()
    assert sorted(r.complaint_id for r in got) == list(range(100))
    assert ordering.ensure_id(rows, "n") is rows


def test_chunks(spark):
    rows = spark.range(0, 250, 1, 4).withColumnRenamed("id", "k")
    sizes = ordering.with_chunks(rows, ["k"]).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in sizes] == [(0, 100), (1, 100), (2, 50)]


def test_first_rows(spark):
    rows = spark.range(20).withColumnRenamed("id", "k")
    assert ordering.first_rows(rows, ["k"], 3).count() == 3
    assert ordering.first_rows(rows, ["k"], None).count() == 20
