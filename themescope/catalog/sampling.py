"""Reproducible samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope import fixed_values as fv
from themescope.catalog import stand_ins as si
from themescope.catalog.registry import query, table
from themescope.functions.draws import draw_hash
from themescope.operators import ordering, preparation as prep, sampling as smp
from themescope.plans.prepare import PrepareOptions, build_working_set
from themescope.session import cut_lineage

_CAP, _TARGET = 7, 250
_SEED = fv.SEED


def _balanced_sql(source: str, key: str, group: str, target: int) -> str:
    """CTEs ending in ``picked``: the balanced sample of ``source``."""
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {si.sql_draw(key, _SEED)}, {key}) AS rn,
         greatest({target} // (SELECT count(DISTINCT {group}) FROM {source}), 1) AS cap
  FROM {source} WHERE {group} IS NOT NULL),
filled AS (
  SELECT *, row_number() OVER (ORDER BY rn > cap, CASE WHEN rn > cap THEN {si.sql_draw(key, f'{_SEED}-fill')} END, {key}) AS place,
         count(*) FILTER (rn <= cap) OVER () AS capped FROM ranked),
picked AS (SELECT * FROM filled WHERE rn <= cap OR place <= {target})"""


@query("thinned_stratum", f"""SELECT doc_id, source FROM documents
WHERE NOT starts_with(source, 'src1') OR {si.sql_unit_draw('doc_id', _SEED)} < {fv.STRATUM_FRACTION}""")
def thinned_stratum(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return smp.thin_stratum(docs, prep.is_stratum(F.col("source"), "src1"), key="doc_id")


@query("capped_groups", f"""SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {si.sql_draw('doc_id', _SEED)}, doc_id) AS rn
  FROM documents) WHERE rn <= {_CAP}""")
def capped_groups(spark: SparkSession, folder: str) -> DataFrame:
    return smp.cap_groups(table(spark, folder, "documents").select("doc_id", "lang"), "lang", _CAP, "doc_id")


@query("capped_order_groups", f"""SELECT o_orderkey, o_orderpriority FROM (
  SELECT o_orderkey, o_orderpriority,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY {si.sql_draw('o_orderkey', _SEED)}, o_orderkey) AS rn
  FROM orders) WHERE rn <= 900""")
def capped_order_groups(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return smp.cap_groups(orders, "o_orderpriority", 900, "o_orderkey")


@query("balanced_sample", f"""WITH docs AS (SELECT doc_id, lang FROM documents), {_balanced_sql('docs', 'doc_id', 'lang', _TARGET)}
SELECT doc_id, lang FROM picked""")
def balanced_sample(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return smp.balanced_sample(docs, "lang", _TARGET, "doc_id")


@query("left_over_rows", f"""WITH r AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {si.sql_draw('doc_id', _SEED)}, doc_id) AS rn FROM documents)
SELECT doc_id, lang FROM r WHERE rn > {_CAP}""")
def left_over_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return smp.left_over(docs, smp.cap_groups(docs, "lang", _CAP, "doc_id"), "doc_id")


@query("shuffled_rows", f"""SELECT doc_id,
  CAST(row_number() OVER (ORDER BY {si.sql_draw('doc_id', _SEED)}, doc_id) - 1 AS BIGINT) AS place FROM documents""")
def shuffled_rows(spark: SparkSession, folder: str) -> DataFrame:
    drawn = table(spark, folder, "documents").select("doc_id", draw_hash("doc_id", _SEED).alias("draw"))
    return ordering.dense_index(drawn, "place", ["draw", "doc_id"]).select("doc_id", "place")


@query("holdout_rows", f"""SELECT doc_id, quality FROM labels
ORDER BY {si.sql_draw('doc_id', f'{_SEED}-holdout')}, doc_id LIMIT {fv.HOLDOUT_ROWS}""")
def holdout_rows(spark: SparkSession, folder: str) -> DataFrame:
    return smp.holdout(table(spark, folder, "labels").select("doc_id", "quality"), key="doc_id")


@query("long_sample", f"""SELECT l_orderkey, l_linenumber FROM lineitem
ORDER BY md5((l_orderkey * 10 + l_linenumber)::VARCHAR || '|{_SEED}'), l_orderkey * 10 + l_linenumber LIMIT 20000""")
def long_sample(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")
    )
    marked = lines.withColumn("every", F.lit(1))
    return smp.cap_groups(marked, "every", 20000, "line").select("l_orderkey", "l_linenumber")


_SET = PrepareOptions(target=_TARGET)


@query("working_set", f"""WITH {si.CLEAN}, {_balanced_sql('clean', 'complaint_id', 'product', _TARGET)},
cut AS (SELECT complaint_id, product, array_to_string(string_split(narrative, ' ')[1:{fv.KEEP_WORDS}], ' ') AS t FROM picked)
SELECT complaint_id, product, md5(t) AS digest, {si.sql_words('t')} AS word_count FROM cut""")
def working_set(spark: SparkSession, folder: str) -> DataFrame:
    clean = cut_lineage(prep.load_and_clean(si.raw_complaints(spark, folder, True)))
    seen = build_working_set(clean, _SET).input
    return seen.select("complaint_id", "product", F.md5("narrative").alias("digest"), "word_count")


@query("working_set_holdout", f"""WITH {si.CLEAN}, {_balanced_sql('clean', 'complaint_id', 'product', _TARGET)}
SELECT complaint_id, issue, sub_issue FROM picked
ORDER BY {si.sql_draw('complaint_id', f'{_SEED}-holdout')}, complaint_id LIMIT {fv.HOLDOUT_ROWS}""")
def working_set_holdout(spark: SparkSession, folder: str) -> DataFrame:
    clean = cut_lineage(prep.load_and_clean(si.raw_complaints(spark, folder, True)))
    held = build_working_set(clean, _SET).holdout
    return held.withColumnsRenamed({"Issue": "issue", "Sub-issue": "sub_issue"})
