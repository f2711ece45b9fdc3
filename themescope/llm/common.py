"""Row keys, stored intermediate tables and Arrow helpers shared by the operators here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope.session import scratch_path

ROW_KEY = "_k"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no recomputation of what stands behind, and lets
    Spark see the true size of a table before it joins it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(docs: DataFrame, id_col: str, *columns: str) -> tuple[DataFrame, bool]:
    """``_k`` (long, unique, ordered like ``id_col``), the id and ``columns``; nothing else.

    Where ids are unique and present the id itself is the key and nothing is moved.  Otherwise rows
    are sorted by (id, columns), missing ids first, numbered in that order and stored, so that every
    row, repeated ones too, is a document of its own.  The second value tells whether that was needed.
    """
    slim = docs.select(F.col(id_col), *[F.col(c) for c in columns])
    whole = dict(slim.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    odd = (slim.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
           .filter(F.col(id_col).isNull() | (F.col("n") > 1)).limit(1).count())
    if whole and odd == 0:
        return slim.select(F.col(id_col).cast("long").alias(ROW_KEY), id_col, *columns), False
    ordered = slim.sort(F.col(id_col).asc_nulls_first(), *columns)
    numbered = ordered.select(F.monotonically_increasing_id().alias(ROW_KEY), id_col, *columns)
    return stored(numbered, "row-key"), True


def with_ids(result: DataFrame, keyed: tuple[DataFrame, bool], id_col: str) -> DataFrame:
    """``result`` with the id in place of ``_k``."""
    base, renumbered = keyed
    if not renumbered:
        kind = base.schema[id_col].dataType
        return result.withColumn(ROW_KEY, F.col(ROW_KEY).cast(kind)).withColumnRenamed(ROW_KEY, id_col)
    return base.select(ROW_KEY, id_col).join(result, ROW_KEY).drop(ROW_KEY)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the len + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]: at[-1]], at - at[0]


def groups_of_rows(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer row stands alone."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end

