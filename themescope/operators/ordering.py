"""Dense row numbers, first rows and fixed-size chunks without a single-task window."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window as W, functions as F

from themescope import fixed_values as fv
from themescope.operators.small import small_side
from themescope.session import cut_lineage

# Layout of monotonically_increasing_id: partition number above, row number below.
_ROW_BITS = 33


def dense_index(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """Number rows 0..n-1, in the given order or in the order they are stored.

    Rows are sorted across tasks and numbered inside each; a table of one offset per
    partition does the rest.  The numbered rows are written once, so a retried task cannot
    number them differently.
    """
    ordered = df.orderBy(*order) if order else df
    slotted = cut_lineage(ordered.withColumn("_slot", F.monotonically_increasing_id()))
    parts = slotted.withColumn("_part", F.shiftright("_slot", _ROW_BITS))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_before"))
    row = F.col("_slot").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        parts.join(small_side(offsets), "_part")
        .withColumn(name, F.col("_before") + row)
        .select(name, *df.columns)
    )


def stored_index(df: DataFrame, name: str) -> DataFrame:
    """Number rows 0..n-1 in the order of their files' paths and their places in them.

    Parquet files know the place of each row, so only a table of one offset per file is made and nothing is
    sorted, moved or written.  A table that leaves out rows of its files is numbered by a sort of that place;
    one that does not come from Parquet files in the order of its partitions.
    """
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return dense_index(df, name)
    files = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"), (F.max("_at") + 1).alias("_rows"))
    if files.filter("_n <> _rows").take(1):
        return dense_index(placed, name, ["_file", "_at"]).drop("_file", "_at")
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_file")) - F.col("_n")
    offsets = small_side(files.select("_file", before.alias("_before")))
    return placed.join(offsets, "_file").select((F.col("_before") + F.col("_at")).alias(name), *df.columns)


def ensure_id(df: DataFrame, key: str = "complaint_id") -> DataFrame:
    """The table itself if it has a key, else with one made up: 0..n-1 in stored order."""
    return df if key in df.columns else stored_index(df, key)


def with_chunks(
    df: DataFrame, order: list[str], rows: int = fv.CHECKPOINT_ROWS, name: str = "chunk"
) -> DataFrame:
    """Number of the run of ``rows`` consecutive rows each row falls in, from 0."""
    indexed = dense_index(df, "_index", order)
    return indexed.withColumn(name, F.floor(F.col("_index") / rows)).drop("_index")


def first_rows(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in order; all rows for ``None`` or 0."""
    return df.orderBy(*order).limit(n) if n else df
