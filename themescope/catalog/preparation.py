"""Raw rows to clean complaints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope import fixed_values as fv
from themescope.catalog import stand_ins as si
from themescope.catalog.registry import query, table, texts
from themescope.functions import dates, text as tx
from themescope.operators import aggregates as agg, preparation as prep
from themescope.plans.prepare import extraction_tests, extract_pool
from themescope.functions.nulls import or_empty


@query("rename_columns", f"""WITH {si.RAW}
SELECT date_received AS date, product, sub_product, md5(narrative) AS narrative, company, state, channel,
       complaint_id, issue, sub_issue FROM raw""")
def rename_columns(spark: SparkSession, folder: str) -> DataFrame:
    return prep.select_renamed(si.raw_complaints(spark, folder)).withColumnsRenamed(
        {"Issue": "issue", "Sub-issue": "sub_issue"}
    ).withColumn("narrative", F.md5("narrative"))


@query("typed_ids", f"""WITH {si.RAW}
SELECT CAST(CAST(complaint_id AS DECIMAL(20,0)) AS BIGINT) AS complaint_id FROM raw WHERE complaint_id IS NOT NULL""")
def typed_ids(spark: SparkSession, folder: str) -> DataFrame:
    raw = prep.select_renamed(si.raw_complaints(spark, folder))
    return prep.typed_key(raw).select("complaint_id")


@query("canonical_products", f"""WITH {si.RAW}
SELECT {si.sql_canonical('product')} AS product, count(*) AS n FROM raw GROUP BY 1""")
def canonical_products(spark: SparkSession, folder: str) -> DataFrame:
    raw = si.raw_complaints(spark, folder).select(prep.canonical_label(F.col("Product")).alias("product"))
    return agg.frequency(raw, "product")


@query("canonical_by_dimension", """WITH dimension AS (
  SELECT source AS variant, CASE WHEN max(n_chars) >= 7000 THEN 'long ' || min(lang) ELSE 'short' END AS canonical
  FROM documents WHERE length(source) > 4 GROUP BY source)
SELECT coalesce(canonical, source) AS source, count(*) AS n
FROM documents LEFT JOIN dimension ON source = variant GROUP BY 1""")
def canonical_by_dimension(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    name = F.when(F.max("n_chars") >= 7000, F.concat(F.lit("long "), F.min("lang"))).otherwise("short")
    dimension = (
        docs.filter(F.length("source") > 4).groupBy(F.col("source").alias("variant"))
        .agg(name.alias("canonical"))
    )
    return agg.frequency(prep.canonicalise(docs.select("source"), "source", dimension), "source")


@query("clean_text", f"""WITH c AS (SELECT doc_id, {si.sql_clean(si._sql_masks('text'))} AS narrative FROM documents)
SELECT doc_id, md5(narrative) AS digest, {si.sql_words('narrative')} AS word_count FROM c""")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).select("doc_id", si.masked_text(F.col("text")).alias("narrative"))
    return prep.with_clean_text(docs).select("doc_id", F.md5("narrative").alias("digest"), "word_count")


@query("raw_word_counts", r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words FROM documents""")
def raw_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query("truncated_text", rf"""WITH c AS (
  SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
s AS (SELECT doc_id, array_to_string(string_split(t, ' ')[1:{fv.KEEP_WORDS}], ' ') AS narrative FROM c)
SELECT doc_id, md5(narrative) AS digest, {si.sql_words('narrative')} AS word_count FROM s""")
def truncated_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).select("doc_id", tx.squeeze(F.col("text")).alias("narrative"))
    return prep.truncate_text(docs).select("doc_id", F.md5("narrative").alias("digest"), "word_count")


@query("length_band", rf"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS word_count FROM documents
WHERE len(regexp_extract_all(text, '\S+')) BETWEEN {fv.MIN_WORDS} AND {fv.MAX_WORDS}""")
def length_band(spark: SparkSession, folder: str) -> DataFrame:
    docs = prep.with_word_count(texts(spark, folder).select("doc_id", "text"), "text")
    return prep.length_band(docs).select("doc_id", "word_count")


@query("usable_complaints", f"""WITH {si.CLEAN}
SELECT complaint_id, date, product, issue, md5(narrative) AS digest, word_count FROM clean""")
def usable_complaints(spark: SparkSession, folder: str) -> DataFrame:
    return prep.load_and_clean(si.raw_complaints(spark, folder, True)).select(
        "complaint_id", "date", "product", F.col("Issue").alias("issue"),
        F.md5("narrative").alias("digest"), "word_count",
    )


@query("input_table", f"""WITH {si.CLEAN}
SELECT complaint_id, strftime(date, '%Y-%m-%d') AS date, product, sub_product, company, state, channel,
       md5(narrative) AS narrative, word_count FROM clean""")
def input_table(spark: SparkSession, folder: str) -> DataFrame:
    seen, _ = prep.split_truth(prep.load_and_clean(si.raw_complaints(spark, folder, True)))
    return prep.with_day_text(seen).withColumn("narrative", F.md5("narrative"))


@query("truth_table", f"""WITH {si.CLEAN} SELECT complaint_id, issue, sub_issue FROM clean""")
def truth_table(spark: SparkSession, folder: str) -> DataFrame:
    _, truth = prep.split_truth(prep.load_and_clean(si.raw_complaints(spark, folder, True)))
    return truth.withColumnsRenamed({"Issue": "issue", "Sub-issue": "sub_issue"})


@query("complete_rows", f"""WITH {si.RAW}
SELECT product, count(*) AS n FROM raw WHERE issue IS NOT NULL AND sub_issue IS NOT NULL GROUP BY product""")
def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    raw = si.raw_complaints(spark, folder)
    return agg.frequency(raw.dropna(subset=["Issue", "Sub-issue"]).select(F.col("Product").alias("product")), "product")


@query("kept_labels", f"""WITH {si.RAW}
SELECT sub_issue, count(*) AS n FROM raw WHERE sub_issue IS NULL OR sub_issue NOT IN ('about src1', 'about src7')
GROUP BY sub_issue""")
def kept_labels(spark: SparkSession, folder: str) -> DataFrame:
    raw = si.raw_complaints(spark, folder).select(F.col("Sub-issue").alias("sub_issue"))
    kept = prep.drop_labels(raw, "sub_issue", ["about src1", "about src7"])
    return kept.groupBy("sub_issue").agg(F.count(F.lit(1)).alias("n"))


@query("recent_rows", f"""WITH {si.RAW}, d AS (SELECT complaint_id, {si._DATE} AS day FROM raw)
SELECT complaint_id, day FROM d WHERE day >= DATE '{fv.MIN_DATE}'""")
def recent_rows(spark: SparkSession, folder: str) -> DataFrame:
    named = prep.select_renamed(si.raw_complaints(spark, folder))
    return prep.since(named).select("complaint_id", dates.parse_utc(F.col("date")).cast("date").alias("day"))


@query("recent_orders", f"""SELECT o_orderkey, o_orderdate AS date FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'""")
def recent_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("date"))
    return prep.since(orders, minimum="1998-01-01")


@query("stratum_size", f"""WITH {si.RAW}
SELECT coalesce(starts_with(sub_issue, 'about src1'), false) AS in_stratum, count(*) AS n FROM raw GROUP BY 1""")
def stratum_size(spark: SparkSession, folder: str) -> DataFrame:
    raw = si.raw_complaints(spark, folder)
    inside = prep.is_stratum(F.col("`Sub-issue`"), "about src1").alias("in_stratum")
    return raw.groupBy(inside).agg(F.count(F.lit(1)).alias("n"))


@query("extraction_pool", f"""WITH {si.RAW}, d AS (SELECT *, {si._DATE} AS day FROM raw)
SELECT complaint_id, product, day FROM d
WHERE narrative IS NOT NULL AND day >= DATE '{fv.MIN_DATE}'
  AND (NOT coalesce(starts_with(product, '{fv.STRATUM_PREFIX}'), false)
       OR {si.sql_unit_draw('complaint_id', fv.SEED)} < {fv.STRATUM_FRACTION})""")
def extraction_pool(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pool(si.raw_complaints(spark, folder)).select(
        F.col("Complaint ID").alias("complaint_id"), F.col("Product").alias("product"),
        dates.parse_utc(F.col("Date received")).cast("date").alias("day"),
    )


@query("extraction_funnel", f"""WITH {si.RAW}, d AS (SELECT *, {si._DATE} AS day FROM raw),
s AS (SELECT count(*) AS a, count(*) FILTER (narrative IS NOT NULL) AS b,
             count(*) FILTER (narrative IS NOT NULL AND day >= DATE '{fv.MIN_DATE}') AS c FROM d)
SELECT 0 AS position, 'scanned' AS stage, a AS rows, 1.0::DOUBLE AS share FROM s
UNION ALL SELECT 1, 'has_text', b, round(b / a, 6) FROM s
UNION ALL SELECT 2, 'recent', c, round(c / a, 6) FROM s""")
def extraction_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return agg.funnel(si.raw_complaints(spark, folder), extraction_tests()).withColumn(
        "share", F.round("share", 6)
    )


@query("token_estimates", f"""SELECT doc_id, CAST(greatest(1, length(text) // {fv.CHARS_PER_TOKEN}) AS INTEGER) AS tokens FROM documents""")
def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("parsed_dates", f"""WITH {si.RAW}, d AS (SELECT date_received, {si._DATE} AS day FROM raw)
SELECT date_received, CAST(date_trunc('month', day) AS DATE) AS month, strftime(day, '%Y-%m-%d') AS day_text,
       strftime(day, '%Y-%m') AS year_month, count(*) AS n FROM d GROUP BY ALL""")
def parsed_dates(spark: SparkSession, folder: str) -> DataFrame:
    when = dates.parse_utc(F.col("date_received"))
    rows = si.raw_complaints(spark, folder).select(F.col("Date received").alias("date_received"))
    return rows.groupBy("date_received").agg(F.count(F.lit(1)).alias("n")).select(
        "date_received", dates.month_of(when).alias("month"), dates.day_text(when).alias("day_text"),
        dates.year_month(when).alias("year_month"), "n",
    )


@query("missing_as_empty", f"""WITH {si.RAW}
SELECT coalesce(sub_issue, '') AS sub_issue, count(*) AS n, sum(length(coalesce(narrative, ''))) AS chars FROM raw GROUP BY 1""")
def missing_as_empty(spark: SparkSession, folder: str) -> DataFrame:
    raw = si.raw_complaints(spark, folder)
    return raw.groupBy(or_empty(F.col("`Sub-issue`")).alias("sub_issue")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length(or_empty(F.col("Consumer complaint narrative")))).alias("chars"),
    )


@query("column_contract", "SELECT count(*) AS rows, 5 AS columns FROM documents")
def column_contract(spark: SparkSession, folder: str) -> DataFrame:
    docs = prep.require_columns(table(spark, folder, "documents"), ["doc_id", "text", "lang", "source"])
    return docs.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(docs.columns)).alias("columns"))
