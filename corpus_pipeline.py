"""From raw documents to token ids: quality filter, exact and near deduplication, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame that is
written as Parquet and read back as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope.llm import bpe, common, decontaminate, exact_dedup, jaccard, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share this percentage of their shingles of so many words, or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality(docs, labels, keep=COLUMNS[1:]).filter("predicted = 1").select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``: unique, never null, ordered like doc_id (missing ids first)."""
    return common.with_row_key(docs, *COLUMNS)[0].withColumnRenamed(common.ROW_KEY, "row")


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    return rows.join(kept.select("row"), "row", "left_semi").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.  Rows with a missing or repeated doc_id are documents of
    their own."""
    rows = _numbered(docs)
    return _only(rows, exact_dedup.exact_groups(rows, "row").filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id (a missing one counts as smallest);
    of rows that agree in it, exactly one."""
    rows = _numbered(docs)
    groups = jaccard.similar_groups(rows, "row", n=NEAR_WORDS, percent=NEAR_PERCENT)
    return _only(rows, groups.filter("component_id = row"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark, each row for itself."""
    rows = _numbered(docs)
    found = decontaminate.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row")
    return _only(rows, found.filter(F.size("items") == 0))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the digests of ids and decoded text."""
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated), ("bpe", tokenise),
]

#: A trained classifier and a tokenizer decide the rows, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
