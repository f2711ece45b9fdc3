"""Cleaning, counting, dates and null rules on hand-made edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from themescope.functions import dates, nulls, text as tx
from themescope.operators import aggregates as agg, preparation as prep


def apply(spark, values, make, kind="string"):
    """Evaluate a column expression on rows (not on constants), in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


CLEAN = [
    ("I paid {$9,800.00} twice", "I paid [AMOUNT] twice"),
    ("fee {$35}.", "fee [AMOUNT] ."),
    ("on XX/XX/XXXX and XX/XX/2023", "on [DATE] and [DATE]"),
    ("since XX/XX it", "since [DATE] it"),
    ("XX/XX/20XX", "[DATE] /20XX"),
    ("XX/XX/XX/XXXX", "XX/ [DATE]".replace("XX/", "[REDACTED] /")),
    ("XXXX " * 40 + "end", "[REDACTED] end"),
    ("aXXXX XXXXb X", "aXXXX XXXXb X"),
    ("éXXXX XXXX", "éXXXX [REDACTED]"),
    ("a b\nc\t d e", "a b c d e"),
    ("[REDACTED] [REDACTED]x", "[REDACTED] x"),
    ("", ""),
    ("XXXX\nXX/XX/XXXX {$1}", "[REDACTED] [DATE] [AMOUNT]"),
    ("1XX XX_ XX-XX", "1XX XX_ [REDACTED] - [REDACTED]"),
    ("plain  text ", "plain text"),
]


@pytest.mark.parametrize("raw,clean", CLEAN)
def test_clean_text(spark, raw, clean):
    assert apply(spark, [raw], tx.clean_text) == [clean]


def test_clean_null(spark):
    assert apply(spark, [None], tx.clean_text) == [None]


def test_word_counts(spark):
    values = ["", "a", "a b", "  a \n b c "]
    assert apply(spark, values, tx.word_count) == [0, 1, 2, 3]
    assert apply(spark, values, lambda c: tx.squeezed_word_count(tx.squeeze(c))) == [0, 1, 2, 3]


def test_truncate(spark):
    words = [" ".join(["w"] * n) for n in (399, 400, 401)]
    cut = apply(spark, words, lambda c: tx.squeezed_word_count(tx.truncate_words(c)))
    assert cut == [399, 400, 400]
    with pytest.raises(ValueError):
        tx.truncate_words(F.col("v"), 0)


def test_length_band(spark):
    rows = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (0, 29, 30, 3000, 3001)], "n int, narrative string")
    kept = prep.length_band(prep.with_clean_text(rows)).select("n").collect()
    assert sorted(r.n for r in kept) == [30, 3000]


def test_token_estimate(spark):
    assert apply(spark, ["", "abc", "abcdefgh", "é" * 9], tx.token_estimate) == [1, 1, 2, 2]


def test_parse_utc(spark):
    values = ["2023-04-11", "2023-04-11T09:07:47Z", "2023", "04/11/2023", "junk", None, "2023-13-40"]
    found = apply(spark, values, dates.parse_utc)
    assert found[:2] == [dt.datetime(2023, 4, 11), dt.datetime(2023, 4, 11, 9, 7, 47)]
    assert found[2:] == [None] * 5
    assert apply(spark, values[:2], lambda c: dates.month_of(dates.parse_utc(c))) == [dt.date(2023, 4, 1)] * 2


def test_null_rules(spark):
    values = ["Other", "Loan", None]
    assert apply(spark, values, lambda c: nulls.not_listed(c, ["Other"])) == [False, True, True]
    assert apply(spark, values, lambda c: nulls.has_prefix(c, "Lo")) == [False, True, False]
    assert apply(spark, ["12", "10298545.0", "x", None], nulls.whole_id) == [12, 10298545, None, None]


def test_null_keys_are_no_group(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "k string")
    assert [tuple(r) for r in agg.frequency(rows, "k").collect()] == [("a", 2), ("b", 1)]


def test_equal_counts_are_ordered_by_value(spark):
    rows = spark.createDataFrame([("c",), ("b",), ("a",), ("c",)], "k string")
    assert [r.k for r in agg.top_values(rows, "k", 2).collect()] == ["c", "a"]


def test_canonical_labels(spark):
    values = ["Payday loan", "Consumer Loan", "Mortgage", None]
    assert apply(spark, values, prep.canonical_label) == [
        "Payday/title/personal loan", "Vehicle or consumer loan", "Mortgage", None
    ]


def test_required_columns(spark):
    rows = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        prep.require_columns(rows, ["a", "c", "b"])


def test_labels_never_reach_the_input(spark, small):
    from themescope.catalog.stand_ins import raw_complaints

    seen, truth = prep.split_truth(prep.load_and_clean(raw_complaints(spark, small)))
    assert not set(seen.columns) & {"Issue", "Sub-issue"}
    assert truth.columns == ["complaint_id", "Issue", "Sub-issue"]


def test_cleaning_runs_once_per_row(spark, plan, small):
    from themescope.catalog.stand_ins import raw_complaints

    raw = spark.read.parquet(f"{small}/documents.parquet").select(
        *[F.col("text").alias(c) for c in raw_complaints(spark, small).columns]
    )
    text = plan(prep.load_and_clean(raw))
    assert text.count("X*+") == 1
    assert "Exchange" not in text
