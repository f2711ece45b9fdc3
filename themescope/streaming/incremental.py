"""Checkpointed, resumable runs: each start handles what arrived since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from themescope import fixed_values as fv
from themescope.operators.ordering import dense_index
from themescope.session import cut_lineage
from themescope.sources.readers import read_table, try_read

Transform = Callable[[DataFrame], DataFrame]

#: Tasks of one job of :func:`run_chunks`.
TASKS_PER_JOB = 4_000


def stream_table(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """A folder of Parquet files as a stream.

    With ``pattern`` only what has such a name in the folder: single files, or tables that are folders of files.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if not pattern:
        return reader.parquet(path)
    # Spark takes a path without wildcards for the root of partition folders, which a single file can't be.
    wild = pattern if set(pattern) & set("*?[{") else f"{pattern[:-1]}[{pattern[-1]}]"
    return reader.parquet(f"{path}/{wild}")


def run_available(source: DataFrame, transform: Transform, sink: str, checkpoint: str) -> int:
    """Process all files not yet processed, append the result to ``sink`` and stop.

    The file sink commits per micro-batch together with the checkpoint, so a run that was
    interrupted, or repeated, ends with the same rows as one uninterrupted run.  Returns the
    number of source rows read.
    """
    return _to_the_end(
        transform(source).writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
    )


def write_chunks(df: DataFrame, order: list[str], path: str, rows: int = fv.CHECKPOINT_ROWS) -> None:
    """Store ``df`` in order, numbered (``_row``), in chunks of ``rows`` consecutive rows (``_chunk``), the unit of
    :func:`run_chunks`."""
    chunk = F.floor(F.col("_row") / rows).alias("_chunk")
    dense_index(df, "_row", order).select("*", chunk).write.mode("overwrite").parquet(path)


def run_chunks(
    spark: SparkSession, work: str, schema: StructType, transform: Transform, sink: str, checkpoint: str,
    chunks_per_batch: int = 1,
) -> int:
    """Put the chunks stored in ``work`` through a costly, narrow ``transform`` and store what it yields.

    Every task takes a slice of consecutive rows and its file counts once the task has ended, whatever becomes of
    the job.  The slices in flight hold the rows of a batch of ``chunks_per_batch`` chunks together: that much a
    crash costs.  A run that died is continued by calling this again: rows of a slice that left a result (columns
    ``_first``, ``_last`` of the sink) are not computed again.  Without its checkpoint a run begins anew and its
    sink is emptied.  Returns the number of rows read.
    """
    held = read_table(spark, work)
    size = held.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_chunk") == 0).alias("chunk")).first()
    batch = max(1, size.chunk * chunks_per_batch)
    # One task more than there are cores: the next one may start before the job knows of a failure.
    per_task = max(1, batch // (spark.sparkContext.defaultParallelism + 1))
    tasks = -(-batch // per_task)  # of a batch; the last one may have fewer rows

    def placed(results: DataFrame, first: int) -> DataFrame:
        number = (F.floor(F.lit(first) / batch) + F.floor(F.spark_partition_id() / tasks)).cast("long")
        start = number * batch + F.pmod(F.spark_partition_id(), F.lit(tasks)) * per_task
        last = F.least(start + per_task, (number + 1) * batch) - 1
        return results.withColumns({"_first": start, "_last": last, "batch": number})

    if try_read(spark, checkpoint) is None:
        nothing = placed(transform(spark.createDataFrame([], schema)), 0)
        spark.createDataFrame([], nothing.schema).write.mode("overwrite").parquet(sink)
        spark.createDataFrame([("started",)], "state string").coalesce(1).write.mode("overwrite").parquet(checkpoint)
        left = held
    else:
        done = read_table(spark, sink).select("_first", "_last").distinct()
        rows_done = done.select(F.explode(F.sequence("_first", "_last")).alias("_row"))
        left = cut_lineage(held.join(rows_done, "_row", "left_anti"))
    rows = left.count()
    batches = max(1, TASKS_PER_JOB // tasks)
    for first in range(0, size.rows, batches * batch) if rows else ():
        here = left.filter(F.col("_row").between(first, first + batches * batch - 1))
        if left is not held and not here.take(1):
            continue
        at = F.col("_row") - first
        task = (F.floor(at / batch) * tasks + F.floor(F.pmod(at, F.lit(batch)) / per_task)).cast("int")
        sliced = here.withColumn("_task", task).repartitionById(
            min(batches, -(-(size.rows - first) // batch)) * tasks, "_task").select(*schema.names)
        # Version 2 of the committer puts a task's file in its place when the task ends.
        placed(transform(sliced), first).write.mode("append").option(
            "mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(sink)
    return rows


def _to_the_end(writer) -> int:
    query = writer.trigger(availableNow=True).start()
    # Spark keeps the reports of the last batches only, so they are gathered while the query runs.
    rows: dict[int, int] = {}
    ended = False
    while not ended:
        ended = query.awaitTermination(1)
        rows.update((p["batchId"], p["numInputRows"]) for p in query.recentProgress)
    if query.exception() is not None:
        raise query.exception()
    return sum(rows.values())
