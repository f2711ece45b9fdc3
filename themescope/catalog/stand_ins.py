"""Complaint-shaped tables derived from the given tables, in Spark and in SQL.

The given tables hold no complaints, so each input a step needs is derived from whole tables by
plain expressions that both engines evaluate alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themescope import fixed_values as fv
from themescope.catalog.registry import table, texts
from themescope.operators.preparation import computed_once

# Words of the text that stand in for redactions.
MASKS = [
    (" the ", " XXXX "),
    (" and ", " XXXX XXXX  XX "),
    (" de ", " XX/XX/XXXX "),
    (" to ", " XX/XX/2023 "),
    (" la ", " XX/XX "),
    (" of ", " {$1,250.00} "),
    (" der ", " {$75} "),
]

# One product label per source.
PRODUCTS = [*fv.CANONICAL_PRODUCT, "Mortgage", "Student loan", "Debt collection", "Other"]
CANONICAL_NAMES = sorted({fv.CANONICAL_PRODUCT.get(p, p) for p in PRODUCTS} - set(fv.DROP_PRODUCTS))
SENTIMENT_BY_STATUS = {"F": "Negative", "O": "Neutral", "P": "Positive"}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def masked_text(text: Column) -> Column:
    return reduce(lambda c, m: F.replace(c, F.lit(m[0]), F.lit(m[1])), MASKS, text)


def raw_complaints(spark: SparkSession, folder: str, for_cleaning: bool = False) -> DataFrame:
    """Raw rows.  ``for_cleaning`` masks the texts once, for queries that go on to read them;
    otherwise masking is left out of plans that do not need the text."""
    docs, masked = texts(spark, folder), masked_text(F.col("text"))
    if for_cleaning:
        docs, masked = computed_once(docs, "masked", masked), F.col("masked")
    day = F.date_format(F.date_add(F.lit("2022-01-01").cast("date"), (F.col("n_chars") % 1500).cast("int")), "yyyy-MM-dd")
    label = F.create_map(*[F.lit(x) for i, p in enumerate(PRODUCTS) for x in (f"src{i}", p)])
    es, de, en = (F.col("lang") == x for x in ("es", "de", "en"))
    return docs.select(
        F.when(es & (F.col("n_chars") > 2000), "unknown")
        .when(F.col("lang") == "fr", F.concat(day, F.lit("T09:07:47Z"))).otherwise(day).alias("Date received"),
        F.try_element_at(label, "source").alias("Product"),
        F.col("lang").alias("Sub-product"),
        F.when(F.col("n_chars") >= 120, masked).alias("Consumer complaint narrative"),
        F.upper("source").alias("Company"),
        F.upper("lang").alias("State"),
        F.lit("Web").alias("Submitted via"),
        F.when(~F.col("text").contains("|"), F.concat(F.col("doc_id").cast("string"), F.when(en, ".0").otherwise(""))).alias("Complaint ID"),
        F.when(~(es & (F.col("n_chars") > 6000)), F.concat_ws("-", "lang", "source")).alias("Issue"),
        F.when(~de, F.concat(F.lit("about "), F.col("source"))).alias("Sub-issue"),
    )


def _sql_masks(column: str) -> str:
    return reduce(lambda c, m: f"replace({c}, '{m[0]}', '{m[1]}')", MASKS, column)


def _sql_case(column: str, pairs: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items())
    return f"CASE {column} {arms} ELSE {default} END"


def sql_canonical(column: str) -> str:
    return _sql_case(column, fv.CANONICAL_PRODUCT, column)


def sql_clean(column: str) -> str:
    """The cleaning rules in the SQL engine's regex dialect (ASCII boundaries, which the masks keep to)."""
    rules = [
        (r"\{\$[\d,]+\.?\d*\}", " [AMOUNT] "),
        (r"\bXX/XX/(?:XXXX|\d{4})\b", " [DATE] "),
        (r"\bXX/XX\b", " [DATE] "),
        (r"\bX{2,}\b", " [REDACTED] "),
        (r"(?:\[REDACTED\]\s*){2,}", " [REDACTED] "),
        (r"\s+", " "),
    ]
    return f"trim({reduce(lambda c, r: f'''regexp_replace({c}, '{r[0]}', '{r[1]}', 'g')''', rules, column)})"


def sql_words(column: str) -> str:
    return f"CAST(CASE WHEN {column} = '' THEN 0 ELSE length({column}) - length(replace({column}, ' ', '')) + 1 END AS INTEGER)"


def sql_draw(key: str, seed: object) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


def sql_unit_draw(key: str, seed: object) -> str:
    return f"CAST('0x' || substr({sql_draw(key, seed)}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


_DAY = "strftime(DATE '2022-01-01' + CAST(n_chars % 1500 AS INTEGER), '%Y-%m-%d')"

RAW = f"""raw AS (
  SELECT CASE WHEN lang = 'es' AND n_chars > 2000 THEN 'unknown'
              WHEN lang = 'fr' THEN {_DAY} || 'T09:07:47Z' ELSE {_DAY} END AS date_received,
         {_sql_case('source', {f'src{i}': p for i, p in enumerate(PRODUCTS)}, 'NULL')} AS product,
         lang AS sub_product,
         CASE WHEN n_chars >= 120 THEN {_sql_masks('text')} END AS narrative,
         upper(source) AS company, upper(lang) AS state, 'Web' AS channel,
         CASE WHEN NOT contains(text, '|')
              THEN CAST(doc_id AS VARCHAR) || CASE WHEN lang = 'en' THEN '.0' ELSE '' END END AS complaint_id,
         CASE WHEN NOT (lang = 'es' AND n_chars > 6000) THEN lang || '-' || source END AS issue,
         CASE WHEN lang <> 'de' THEN 'about ' || source END AS sub_issue
  FROM documents)"""

_DATE = "CASE WHEN regexp_matches(date_received, '^\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(substr(date_received, 1, 10) AS DATE) END"

CLEAN = f"""{RAW}, cleaned AS (
  SELECT CAST(CAST(complaint_id AS DECIMAL(20,0)) AS BIGINT) AS complaint_id, {_DATE} AS date,
         {sql_canonical('product')} AS product, sub_product, company, state, channel, issue, sub_issue,
         {sql_clean('narrative')} AS narrative
  FROM raw WHERE narrative IS NOT NULL AND complaint_id IS NOT NULL),
clean AS (
  SELECT *, {sql_words('narrative')} AS word_count FROM cleaned
  WHERE (product IS NULL OR product NOT IN ({', '.join(f"'{p}'" for p in fv.DROP_PRODUCTS)}))
    AND date IS NOT NULL AND issue IS NOT NULL
    AND {sql_words('narrative')} BETWEEN {fv.MIN_WORDS} AND {fv.MAX_WORDS})"""


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled complaints for the reports: orders with their customer's segment."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    price = F.col("o_totalprice")
    by_status = F.create_map(*[F.lit(x) for pair in SENTIMENT_BY_STATUS.items() for x in pair])
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("complaint_id"),
        F.when(price >= 20000, F.col("o_orderpriority")).alias("general_topic_l1"),
        F.when(price > 400000, "Mixed").otherwise(F.try_element_at(by_status, "o_orderstatus")).alias("customer_sentiment"),
        F.col("c_mktsegment").alias("product"),
        F.col("o_orderdate").alias("date"),
        F.when(price >= 50000, F.col("o_orderstatus")).alias("topic_discussed"),
    )


LABELLED = f"""labelled AS (
  SELECT o_orderkey AS complaint_id, CASE WHEN o_totalprice >= 20000 THEN o_orderpriority END AS general_topic_l1,
         CASE WHEN o_totalprice > 400000 THEN 'Mixed' ELSE {_sql_case('o_orderstatus', SENTIMENT_BY_STATUS, 'NULL')} END AS customer_sentiment,
         c_mktsegment AS product, o_orderdate AS date,
         CASE WHEN o_totalprice >= 50000 THEN o_orderstatus END AS topic_discussed
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def longest_words(text: Column, n: int) -> Column:
    """The ``n`` longest distinct words of a whole text, later ones in the alphabet first among equals."""
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "))
    keys = F.transform(words, lambda w: F.concat(F.lpad(F.length(w).cast("string"), 9, "0"), w))
    return F.transform(F.slice(F.sort_array(keys, asc=False), 1, n), lambda k: F.substring(k, 10, 2147483647))


def sql_longest_words(text: str, n: int) -> str:
    words = rf"list_distinct(string_split(trim(regexp_replace({text}, '\s+', ' ', 'g')), ' '))"
    keys = f"list_transform({words}, lambda w: lpad(CAST(length(w) AS VARCHAR), 9, '0') || w)"
    return f"list_transform(list_reverse_sort({keys})[1:{n}], lambda k: substr(k, 10))"


def topic_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Complaints with a topic list and a cluster: the longest words of each whole document."""
    return texts(spark, folder).select(
        F.col("doc_id").alias("complaint_id"),
        longest_words(F.lower("text"), 5).alias("all_topics_discussed"),
        F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("cluster_id"),
        "lang", "source",
    )


TOPIC_ROWS = f"""topic_rows AS (
  SELECT doc_id AS complaint_id, {sql_longest_words('lower(text)', 5)} AS all_topics_discussed,
         CAST(substr(source, 4) AS INTEGER) AS cluster_id, lang, source
  FROM documents)"""


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed clustering against a true category: order priority against customer segment and status."""
    return labelled(spark, folder).select(
        "complaint_id", F.concat_ws("/", "product", F.coalesce("topic_discussed", F.lit("?"))).alias("truth"),
        "general_topic_l1",
    ).withColumn("cluster_id", F.substring("general_topic_l1", 1, 1).cast("int"))


JUDGED = f"""{LABELLED}, judged AS (
  SELECT complaint_id, product || '/' || coalesce(topic_discussed, '?') AS truth, general_topic_l1,
         CAST(substr(general_topic_l1, 1, 1) AS INTEGER) AS cluster_id FROM labelled)"""


def document_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Documents clustered by source, with language and source as true category."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("complaint_id"), F.col("source").alias("cluster_id"),
        F.concat_ws("-", "lang", "source").alias("truth"),
    )


DOCUMENT_CELLS = """document_cells AS (
  SELECT doc_id AS complaint_id, source AS cluster_id, lang || '-' || source AS truth FROM documents)"""
