"""Exact deduplication by skew-safe combining, DataFrame operations only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from themescope.llm.common import ROW_KEY, stored, with_ids, with_row_key

SALTS = 32
_SPACES = " \t\n\x0b\x0c\r"


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), _SPACES, "")


_WIDE = "decimal(38,0)"
#: 2^63 makes a key non-negative, 2^64 is the room it takes.
_SHIFT, _FIELD = Decimal(1 << 63), Decimal(1 << 64)


def _rank(length, key):
    """Orders rows by length, then by falling key, in one number that hash aggregation can hold."""
    return (length.cast("decimal(12,0)") * F.lit(_FIELD) - (key.cast("decimal(20,0)") + F.lit(_SHIFT))).cast(_WIDE)


def _key(rank):
    return (F.pmod(-rank, F.lit(_FIELD)) - F.lit(_SHIFT)).cast("long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters 0x20 and 0x09-0x0D; a missing text is an
    empty one, and all empty texts form one group.  The row with most code points in its original text
    stays, then the one with the smallest id (a missing id counts as smallest; of rows that agree in id
    and text any one, exactly one, stays).  Extra columns are not looked at; an empty table gives none.

    Rows are combined in three steps, each of which groups by digest *and* whole content: within each
    task before the first shuffle, then by (digest, salt), then over all salts.  A group that holds a
    third of all rows reaches the shuffle as one row per task and is spread over ``salts`` tasks.  Rows
    then meet the winner of their digest by digest alone, which is exact: the last step has counted the
    contents of each digest, and a digest with two contents is joined by content.
    """
    keyed = with_row_key(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = keyed[0].select(
        ROW_KEY, F.length(text).alias("length"), normalised(F.col(text_col)).alias("content"),
    ).select("*", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    salted = (rows.withColumn("salt", F.pmod(F.xxhash64(ROW_KEY), F.lit(salts)))
              .groupBy("digest", "salt", "content")
              .agg(F.count(F.lit(1)).alias("n"), F.max(_rank(F.col("length"), F.col(ROW_KEY))).alias("best")))
    merged = salted.groupBy("digest", "content").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    winners = stored(merged.select("digest", "n", _key(F.col("best")).alias("keep")), "exact-winners")
    if winners.groupBy("digest").count().filter("count > 1").limit(1).count():
        # equal digests of different contents: let the content decide
        contents = stored(merged.select("digest", "content", "n", _key(F.col("best")).alias("keep")), "exact-contents")
        joined = rows.join(contents, ["digest", "content"]).select(ROW_KEY, "digest", "n", "keep")
    else:
        groups = stored(winners.filter("n > 1"), "exact-copies")
        joined = rows.select(ROW_KEY, "digest").join(groups, "digest", "left")
    result = joined.select(
        ROW_KEY, F.coalesce("keep", ROW_KEY).alias("keep"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep", ROW_KEY) == F.col(ROW_KEY)).alias("kept"), F.col("digest").alias("text_sha256"))
    if keyed[1]:
        names = keyed[0].select(F.col(ROW_KEY).alias("keep"), F.col(id_col).alias("keep_id"))
        result = result.join(names, "keep").drop("keep")
    else:
        result = result.withColumnRenamed("keep", "keep_id")
    return with_ids(result, keyed, id_col).select(id_col, "keep_id", "group_size", "kept", "text_sha256")
