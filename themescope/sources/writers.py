"""Writing: whole stage tables, appended runs and CSV exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from themescope.operators.joins import not_done
from themescope.sources.readers import read_table, try_read


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Replace a stage table and read it back, so later steps start from stored rows.

    Texts are most of its bytes and each step has a table, so it is packed closer than by default.
    """
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return read_table(df.sparkSession, path, df.schema)


def append_run(df: DataFrame, path: str, resume: bool = True) -> DataFrame:
    """Add a run's rows to its stage table; without ``resume`` start the table afresh.

    Files become visible when the job commits, so an interrupted run leaves no half table.
    """
    df.write.mode("append" if resume else "overwrite").parquet(path)
    return read_table(df.sparkSession, path, df.schema)


def append_missing(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append only rows whose key the table does not hold: running twice adds nothing."""
    stored = try_read(df.sparkSession, path)
    return append_run(df if stored is None else not_done(df, stored, keys), path)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Store a table in buckets of its key, each in key order, and read it back.

    Tables with the same number of buckets are joined and grouped by that key without a shuffle, each time.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """The table as CSV with a header; lists become text.  One file only on request."""
    lists = {
        name: F.to_json(name) for name, kind in df.dtypes if kind.startswith(("array", "struct", "map"))
    }
    flat = df.withColumns(lists) if lists else df
    if single_file:
        flat = flat.coalesce(1)
    flat.write.mode("overwrite").options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
