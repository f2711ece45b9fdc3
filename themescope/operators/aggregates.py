"""Counts, shares, percentiles and profiles of complaint tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from themescope import fixed_values as fv
from themescope.functions.dates import month_of, parse_utc
from themescope.functions.lists import each_item
from themescope.operators.small import small_side
from themescope.session import cut_lineage


def frequency(df: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Rows per value, most frequent first, equal counts by value; NULL is no value."""
    return (
        df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(count))
        .orderBy(F.desc(count), key)
    )


def top_values(df: DataFrame, key: str, n: int = fv.TOP_THEMES, count: str = "n") -> DataFrame:
    return frequency(df, key, count).limit(n)


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column, in one row."""
    counter = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[counter(F.col(c)).alias(f"distinct_{c}") for c in columns])


def largest_share(df: DataFrame, key: str) -> DataFrame:
    """Share of the largest group among all grouped rows."""
    return frequency(df, key).agg(
        F.round(F.max("n") / F.sum("n"), 3).alias("largest_share"), F.count(F.lit(1)).alias("groups")
    )


def with_row_shares(df: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Frequency table with each value's share of all counted rows."""
    table = frequency(df, key, count)
    total = table.agg(F.sum(count)).scalar()
    return table.withColumn("share", F.col(count) / total)


def theme_product_counts(
    df: DataFrame, theme: str = "general_topic_l1", product: str = "product",
    mention: str = "topic_discussed",
) -> DataFrame:
    """Non-NULL mentions per theme and product, long form."""
    keyed = df.filter(F.col(theme).isNotNull() & F.col(product).isNotNull())
    return keyed.groupBy(theme, product).agg(F.count(mention).alias("mentions"))


def theme_product_matrix(
    df: DataFrame, products: Sequence[str], theme: str = "general_topic_l1",
    product: str = "product", mention: str = "topic_discussed",
) -> DataFrame:
    """The same counts as a matrix, one column per given product, gaps 0."""
    keyed = df.filter(F.col(theme).isNotNull() & F.col(product).isNotNull())
    return keyed.groupBy(theme).pivot(product, list(products)).agg(F.count(mention)).fillna(0)


def sentiment_shares(
    df: DataFrame, themes: DataFrame, theme: str = "general_topic_l1",
    sentiment: str = "customer_sentiment",
) -> DataFrame:
    """Percentage of each sentiment per top theme, ranked within the sentiment.

    Only the three known sentiments count, above and below the line; a theme that has none of
    them gets 0.  Long form: one row per theme and sentiment.
    """
    def hits(value: str) -> Column:
        return F.count_if(F.col(sentiment) == value)

    keyed = only_themes(df, themes, theme).filter(F.col(sentiment).isNotNull())
    counts = keyed.groupBy(theme).agg(*[hits(s).alias(s) for s in fv.SENTIMENTS])
    total = sum((F.col(s) for s in fv.SENTIMENTS), F.lit(0))
    pairs = F.array(*[
        F.struct(F.lit(s).alias("sentiment"), F.col(s).alias("n")) for s in fv.SENTIMENTS
    ])
    share = F.when(F.col("total") > 0, F.col("p.n") * 100.0 / F.col("total")).otherwise(0.0)
    rank = F.row_number().over(W.partitionBy("sentiment").orderBy(F.desc("share"), theme))
    return (
        counts.select(theme, total.alias("total"), F.explode(pairs).alias("p"))
        .select(theme, "p.sentiment", F.col("p.n").alias("n"), share.alias("share"))
        .withColumn("rank", rank)
    )


def only_themes(df: DataFrame, themes: DataFrame, theme: str = "general_topic_l1") -> DataFrame:
    """Rows of the given (few) themes."""
    return df.join(small_side(themes.select(theme)), theme, "left_semi")


def monthly_trend(
    df: DataFrame, themes: DataFrame, theme: str = "general_topic_l1", date: str = "date"
) -> DataFrame:
    """Rows per month and top theme; unreadable dates are dropped, empty months stay absent."""
    when = parse_utc(F.col(date)) if dict(df.dtypes)[date] == "string" else F.col(date)
    return (
        only_themes(df, themes, theme).withColumn("month", month_of(when))
        .filter(F.col("month").isNotNull())
        .groupBy("month", theme).agg(F.count(F.lit(1)).alias("count"))
    )


def length_percentiles(
    df: DataFrame, words: str = "word_count",
    points: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99), accuracy: int | None = None,
) -> DataFrame:
    """Percentiles and maximum of text length in one row.

    The exact form keeps one counter per distinct length, which word counts keep small; with
    ``accuracy`` a sketch of fixed size is used.
    """
    levels = F.array(*[F.lit(p) for p in points])
    if accuracy is None:
        measured = F.percentile(words, levels)
    else:
        measured = F.percentile_approx(words, list(points), accuracy)
    named = [F.col("_p")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(points)]
    return df.agg(measured.alias("_p"), F.max(words).alias("longest")).select(
        *named, F.col("longest"), F.floor(F.col("_p")[list(points).index(0.5)]).alias("median_words")
        if 0.5 in points else F.lit(None).cast("bigint").alias("median_words"),
    )


def months_covered(df: DataFrame, date: str = "date") -> DataFrame:
    when = parse_utc(F.col(date)) if dict(df.dtypes)[date] == "string" else F.col(date)
    return df.agg(F.countDistinct(month_of(when)).alias("months"))


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """How many rows pass each stage and all before it, counted in one pass.

    One row per stage with its share of all rows scanned.
    """
    passed, counters = F.lit(True), [F.count(F.lit(1)).alias("_0")]
    for i, test in enumerate(stages.values(), 1):
        passed = passed & F.coalesce(test, F.lit(False))
        counters.append(F.count_if(passed).alias(f"_{i}"))
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("stage"), F.col(f"_{i}").alias("rows"))
        for i, name in enumerate(["scanned", *stages])
    ])
    share = F.when(F.col("_0") > 0, F.col("s.rows") / F.col("_0")).otherwise(0.0)
    return df.agg(*counters).select(F.explode(rows).alias("s"), "_0").select(
        "s.position", "s.stage", "s.rows", share.alias("share")
    )


def category_profile(
    df: DataFrame, category: str = "product", issue: str = "Issue", text: str = "narrative",
    words: str = "word_count",
) -> DataFrame:
    """Per category: rows, share with text, distinct issues, weight of the two largest issues
    among rows with text, and median length.

    Rows meet their category only as one row per (category, issue, length), so a dominant
    category is combined before it is shuffled; both uses read those combined rows, the texts
    are scanned once.
    """
    told = F.col(text).isNotNull()
    cells = cut_lineage(
        df.filter(F.col(category).isNotNull())
        .groupBy(category, issue, words)
        .agg(F.count(F.lit(1)).alias("_rows"), F.count_if(told).alias("_told"))
    )
    lengths = cells.groupBy(category).agg(
        F.sum("_rows").alias("rows"), F.sum("_told").alias("with_text"),
        F.expr(f"percentile(case when _told > 0 then {words} end, 0.5, _told)").alias("median_words"),
    )
    issues = (
        cells.filter(F.col(issue).isNotNull() & (F.col("_told") > 0))
        .groupBy(category, issue).agg(F.sum("_told").alias("_n"))
    )
    rank = F.row_number().over(W.partitionBy(category).orderBy(F.desc("_n"), issue))
    top = issues.withColumn("_rank", rank).groupBy(category).agg(
        F.count(F.lit(1)).alias("distinct_issues"),
        (F.sum(F.when(F.col("_rank") <= 2, F.col("_n"))) / F.sum("_n")).alias("top2_share"),
    )
    return lengths.join(top, category, "left").select(
        category, "rows", "with_text", (F.col("with_text") / F.col("rows")).alias("text_rate"),
        F.coalesce("distinct_issues", F.lit(0)).alias("distinct_issues"), "top2_share", "median_words",
    )


def vocabulary(df: DataFrame, topics: str = "all_topics_discussed") -> DataFrame:
    """Sorted distinct topic phrases."""
    phrases = each_item(df.select(F.col(topics).alias("topic")), "topic")
    return phrases.distinct().orderBy("topic")


def total_topics(df: DataFrame, topics: str = "all_topics_discussed") -> DataFrame:
    size = F.when(F.col(topics).isNotNull(), F.size(topics)).otherwise(0)
    return df.agg(F.sum(size).cast("bigint").alias("total_topics"))
