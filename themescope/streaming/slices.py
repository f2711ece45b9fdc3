"""Answers of a caller's model that tasks store slice by slice.

A task that commits a file of its own costs far more than the few rows it may hold in flight.  Where executors reach
the run's folder as a mounted one, a task takes many slices and puts the answers of each in a file beside the run, an
Arrow stream that can be read wherever it was cut off.  These files serve a crash only: what Spark commits is the sink.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from themescope.operators.extraction import Hook
from themescope.session import cut_lineage
from themescope.sources.readers import read_table, try_read

#: Rows of a task at most, unless there were more than so many tasks.
ROWS_PER_TASK, MOST_TASKS = 10_000, 4_000
_PLACE = [StructField(name, LongType()) for name in ("_first", "_last", "batch")]
_CLOSED = "closed"


def mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as a file name for Python, if it names a mounted folder and no remote store."""
    url = urlsplit(path)
    scheme = url.scheme or urlsplit(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    if scheme != "file" or url.netloc:
        return None
    return os.path.abspath(unquote(url.path) if url.scheme else path)


def _stored(path: str) -> Iterator[pa.RecordBatch]:
    """The slices of a file, up to where it was cut off."""
    try:
        with pa.ipc.open_stream(path) as stream:
            yield from stream
    except (pa.ArrowInvalid, OSError):
        return


def in_slices(hook: Hook, schema: StructType, folder: str, size: int, batch: int) -> Hook:
    """``hook`` called for ``size`` rows at a time; what it answers is in ``folder`` before it gets the next ones.

    Takes rows in order of ``_row`` and adds ``_first``, ``_last`` and ``batch`` to the answers.  A task that runs again
    asks only for rows without stored answers.  Once the folder is closed nothing more is asked.
    """
    kept = to_arrow_schema(StructType(schema.fields + _PLACE))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        mine = f"{task.partitionId():06d}-"
        done: list[tuple[int, int]] = []
        for name in sorted(n for n in os.listdir(folder) if n.startswith(mine)):
            for held in _stored(f"{folder}/{name}"):
                answers = held.to_pandas()
                if (place := (int(answers["_first"].iloc[0]), int(answers["_last"].iloc[0]))) not in done:
                    done.append(place)
                    yield answers
        with open(f"{folder}/{mine}{task.taskAttemptId():012d}", "xb") as file, pa.ipc.new_stream(file, kept) as log:
            for rows in batches:
                for first, last in done:
                    rows = rows[(rows["_row"] < first) | (rows["_row"] > last)]
                for at in range(0, len(rows), size):
                    part = rows.iloc[at:at + size]
                    if os.path.exists(f"{folder}/{_CLOSED}"):
                        raise RuntimeError("this run was left and is continued by another call")
                    place = {"_first": int(part["_row"].iloc[0]), "_last": int(part["_row"].iloc[-1])}
                    asked = part.drop(columns="_row").reset_index(drop=True)
                    said = [a for a in hook(iter([asked])) if len(a)]
                    if not said:
                        continue
                    answers = pd.concat(said, ignore_index=True).assign(**place, batch=place["_first"] // batch)
                    log.write_batch(pa.RecordBatch.from_pandas(answers, kept, preserve_index=False))
                    file.flush()
                    yield answers

    return run


def take_in(spark: SparkSession, folder: str, schema: StructType, sink: str) -> None:
    """Add to the sink the slices that tasks stored and did not commit, and close their folders."""
    calls = sorted(entry.path for entry in os.scandir(folder) if entry.is_dir()) if os.path.isdir(folder) else []
    for call in calls:
        open(f"{call}/{_CLOSED}", "wb").close()
    if not calls:
        return
    kept = StructType(schema.fields + _PLACE)

    def read(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in files:
            for path in group["path"]:
                for held in _stored(unquote(urlsplit(path).path)):
                    yield held.to_pandas().assign(_path=path)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").option("recursiveFileLookup", "true")
    found = files.load([f"file://{c}" for c in calls]).select("path").mapInPandas(
        read, StructType([*kept.fields, StructField("_path", StringType())]))
    committed = read_table(spark, sink).select("_first").distinct()
    # A slice may stand in the files of two attempts; a committed one is in the sink already.
    told = cut_lineage(found.join(committed, "_first", "left_anti"))
    once = told.groupBy("_first").agg(F.min("_path").alias("_path"))
    told.join(once, ["_first", "_path"], "left_semi").select(*kept.names).write.mode("append").parquet(sink)


def empty(spark: SparkSession, folder: str) -> None:
    """Drop all slices: they are in the sink, or the run begins anew."""
    spark.createDataFrame([], "state string").write.mode("overwrite").parquet(f"file://{folder}")


def run_slices(
    spark: SparkSession, work: str, asked: DataFrame, hook: Hook, schema: StructType, sink: str, checkpoint: str,
    folder: str, chunks_per_batch: int = 1,
) -> int:
    """:func:`themescope.streaming.incremental.run_chunks` for a hook, with long tasks.

    ``asked`` has the rows of ``work`` (``_row``, and what the hook gets).  The slices in flight, one a core and one
    more, hold the rows of a batch of ``chunks_per_batch`` chunks together: that much a crash costs.  ``folder``
    (mounted) holds the slices until the call ends.
    """
    held = read_table(spark, work)
    told = held.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_chunk") == 0).alias("chunk")).first()
    batch = max(1, told.chunk * chunks_per_batch)
    cores = spark.sparkContext.defaultParallelism
    kept = StructType(schema.fields + _PLACE)
    left, rows = asked, told.rows
    if try_read(spark, checkpoint) is None:
        empty(spark, folder)
        spark.createDataFrame([], kept).write.mode("overwrite").parquet(sink)
        spark.createDataFrame([("started",)], "state string").coalesce(1).write.mode("overwrite").parquet(checkpoint)
    else:
        take_in(spark, folder, schema, sink)
        empty(spark, folder)
        done = read_table(spark, sink).select("_first", "_last").distinct()
        # Numbers of rows only: written once, so that Spark knows their bytes and need not move the texts.
        rows_done = cut_lineage(done.select(F.explode(F.sequence("_first", "_last")).alias("_row")).distinct())
        left = asked.join(rows_done, "_row", "left_anti")
        rows -= held.select("_row").join(rows_done, "_row", "left_semi").count()
    if rows:
        call = f"{folder}/{uuid.uuid4().hex}"
        os.makedirs(call)
        tasks = min(MOST_TASKS, max(4 * cores, -(-rows // ROWS_PER_TASK)))
        task = F.floor(F.col("_row") * tasks / told.rows).cast("int")
        sliced = left.withColumn("_task", task).repartitionById(tasks, "_task").drop("_task").sortWithinPartitions("_row")
        answers = sliced.mapInPandas(in_slices(hook, schema, call, max(1, batch // (cores + 1)), batch), kept)
        # Version 2 of the committer puts a task's file in its place when the task ends.
        answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(sink)
        empty(spark, folder)
    return rows
