"""Counts, shares and the report bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope import fixed_values as fv
from themescope.catalog import stand_ins as si
from themescope.catalog.registry import query, table, texts
from themescope.functions import text as tx
from themescope.operators import aggregates as agg, preparation as prep
from themescope.plans.insights import generate_insights

_THEME = "general_topic_l1"
_TOP = f"""{si.LABELLED}, top AS (
  SELECT general_topic_l1, count(*) AS n FROM labelled WHERE general_topic_l1 IS NOT NULL
  GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3)"""


def _bundle(spark: SparkSession, folder: str, **options: object) -> dict[str, DataFrame]:
    return generate_insights(si.labelled(spark, folder), top_n=3, **options)


@query("category_shares", f"""WITH {si.CLEAN}
SELECT product, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM clean GROUP BY product""")
def category_shares(spark: SparkSession, folder: str) -> DataFrame:
    clean = prep.load_and_clean(si.raw_complaints(spark, folder, True)).select("product")
    return agg.with_row_shares(clean, "product").withColumn("share", F.round("share", 6))


@query("theme_frequency", f"WITH {si.LABELLED} SELECT general_topic_l1, count(*) AS n FROM labelled WHERE general_topic_l1 IS NOT NULL GROUP BY 1")
def theme_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return agg.frequency(si.labelled(spark, folder), _THEME)


@query("top_themes", f"WITH {_TOP} SELECT * FROM top")
def top_themes(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder)["top_themes"]


@query("distinct_counts", """SELECT count(DISTINCT source) AS distinct_source, count(DISTINCT lang) AS distinct_lang,
       count(DISTINCT n_chars) AS distinct_n_chars FROM documents""")
def distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return agg.distinct_counts(table(spark, folder, "documents"), ["source", "lang", "n_chars"])


@query("theme_by_product", f"""WITH {si.LABELLED}
SELECT general_topic_l1, product, count(topic_discussed) AS mentions FROM labelled
WHERE general_topic_l1 IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2""")
def theme_by_product(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder)["theme_by_product"]


@query("theme_product_matrix", f"""WITH {si.LABELLED} SELECT general_topic_l1,
{', '.join(f"count(topic_discussed) FILTER (product = '{s}') AS {s.lower()}" for s in si.SEGMENTS)}
FROM labelled WHERE general_topic_l1 IS NOT NULL GROUP BY 1""")
def theme_product_matrix(spark: SparkSession, folder: str) -> DataFrame:
    matrix = _bundle(spark, folder, products=si.SEGMENTS)["theme_product_matrix"]
    return matrix.withColumnsRenamed({s: s.lower() for s in si.SEGMENTS})


@query("sentiment_shares", f"""WITH {_TOP}, s AS (SELECT unnest({fv.SENTIMENTS}) AS sentiment),
c AS (SELECT l.general_topic_l1, sentiment, count(*) FILTER (customer_sentiment = sentiment) AS n,
             count(*) FILTER (list_contains({fv.SENTIMENTS}, customer_sentiment)) AS total
      FROM labelled l JOIN top USING (general_topic_l1), s WHERE customer_sentiment IS NOT NULL GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN total > 0 THEN n * 100.0::DOUBLE / total ELSE 0 END AS share FROM c)
SELECT general_topic_l1, sentiment, n, round(share, 6) AS share,
       CAST(row_number() OVER (PARTITION BY sentiment ORDER BY share DESC, general_topic_l1) AS INTEGER) AS rank FROM p""")
def sentiment_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder)["sentiment_shares"].withColumn("share", F.round("share", 6))


@query("monthly_trend", f"""WITH {_TOP}
SELECT CAST(date_trunc('month', date) AS DATE) AS month, general_topic_l1, count(*) AS count
FROM labelled JOIN top USING (general_topic_l1) WHERE date IS NOT NULL GROUP BY 1, 2""")
def monthly_trend(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder)["monthly_trend"]


@query("insight_counts", f"""WITH {si.LABELLED}
SELECT count(*) AS input_rows, count(DISTINCT general_topic_l1) AS distinct_themes, 3 AS top_n FROM labelled""")
def insight_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder)["counts"]


@query("largest_theme_share", f"""WITH {si.LABELLED}, c AS (
  SELECT count(*) AS n FROM labelled WHERE general_topic_l1 IS NOT NULL GROUP BY general_topic_l1)
SELECT round(max(n) / sum(n), 3) AS largest_share, count(*) AS groups FROM c""")
def largest_theme_share(spark: SparkSession, folder: str) -> DataFrame:
    return agg.largest_share(si.labelled(spark, folder), _THEME)


_WORDS = r"w AS (SELECT len(regexp_extract_all(text, '\S+')) AS word_count FROM documents)"


@query("length_percentiles", f"""WITH {_WORDS}, p AS (SELECT
  {', '.join(f'round(quantile_cont(word_count, {p / 100}), 6) AS p{p}' for p in (10, 25, 50, 75, 90, 99))},
  CAST(max(word_count) AS INTEGER) AS longest FROM w) SELECT *, CAST(floor(p50) AS BIGINT) AS median_words FROM p""")
def length_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).select(tx.word_count(F.col("text")).alias("word_count"))
    return agg.length_percentiles(docs).withColumns({
        f"p{p}": F.round(f"p{p}", 6) for p in (10, 25, 50, 75, 90, 99)
    })


@query("months_covered", "SELECT count(DISTINCT date_trunc('month', o_orderdate)) AS months FROM orders")
def months_covered(spark: SparkSession, folder: str) -> DataFrame:
    return agg.months_covered(table(spark, folder, "orders"), "o_orderdate")


@query("category_profile", rf"""WITH {si.RAW},
d AS (SELECT product, issue, narrative, len(regexp_extract_all(narrative, '\S+')) AS words FROM raw),
i AS (SELECT product, issue, count(*) AS n, row_number() OVER (PARTITION BY product ORDER BY count(*) DESC, issue) AS rn
      FROM d WHERE narrative IS NOT NULL AND issue IS NOT NULL GROUP BY product, issue),
j AS (SELECT product, count(*) AS distinct_issues, sum(n) FILTER (rn <= 2) / sum(n) AS top2_share FROM i GROUP BY product)
SELECT d.product, count(*) AS rows, count(narrative) AS with_text, round(count(narrative) / count(*), 6) AS text_rate,
       coalesce(max(distinct_issues), 0) AS distinct_issues, round(max(top2_share), 6) AS top2_share,
       quantile_cont(words, 0.5) AS median_words
FROM d LEFT JOIN j USING (product) GROUP BY d.product""")
def category_profile(spark: SparkSession, folder: str) -> DataFrame:
    raw = prep.select_renamed(si.raw_complaints(spark, folder, True)).withColumn(
        "word_count", tx.word_count(F.col("narrative"))
    )
    return agg.category_profile(raw).withColumns({
        "text_rate": F.round("text_rate", 6), "top2_share": F.round("top2_share", 6)
    })


@query("vocabulary", f"WITH {si.TOPIC_ROWS} SELECT DISTINCT unnest(all_topics_discussed) AS topic FROM topic_rows")
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return agg.vocabulary(si.topic_rows(spark, folder))


@query("total_topics", f"WITH {si.TOPIC_ROWS} SELECT CAST(sum(len(all_topics_discussed)) AS BIGINT) AS total_topics FROM topic_rows")
def total_topics(spark: SparkSession, folder: str) -> DataFrame:
    return agg.total_topics(si.topic_rows(spark, folder))
