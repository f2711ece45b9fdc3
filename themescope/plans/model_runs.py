"""Model runs over an input table that commit as they go and can be continued.

A run is a folder: the rows it has to ask for in chunks, the attempts as its tasks stored them, and the
resolved result.  A table of runs tells which of them were started and which ended.  A caller's process may
die anywhere: the next call first continues the runs that did not end, and only what was in flight is asked again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from themescope import fixed_values as fv
from themescope.operators import attempts as att, joins
from themescope.operators.extraction import Hook, run_hook
from themescope.schemas import RESPONSES
from themescope.sources.readers import read_table, try_read
from themescope.sources.writers import append_missing, append_run, write_stage
from themescope.streaming.incremental import run_chunks, write_chunks
from themescope.streaming.slices import mounted, run_slices

RUNS = "run_id string, state string, rows long"
#: What a hook gets.
ASKED = ["dataset_id", "complaint_id", "narrative"]
ANSWER = ["all_topics_discussed", "supporting_quote", "ai_topic_reasoning", "customer_sentiment",
          "extraction_ok", "model_version"]


@dataclass(frozen=True)
class RunCounts:
    """What the runs of one call did."""

    attempted: int = 0
    newly_processed: int = 0
    prompt_tokens: int = 0
    completion_tokens: int = 0
    failure_samples: tuple[str, ...] = ()

    def plus(self, other: "RunCounts") -> "RunCounts":
        return RunCounts(
            self.attempted + other.attempted, self.newly_processed + other.newly_processed,
            self.prompt_tokens + other.prompt_tokens, self.completion_tokens + other.completion_tokens,
            (self.failure_samples + other.failure_samples)[: fv.ERROR_SAMPLES],
        )


def _note(spark: SparkSession, folder: str, run: str, state: str, rows: int) -> None:
    append_run(spark.createDataFrame([(run, state, rows)], RUNS).coalesce(1), f"{folder}/runs")


def unfinished(spark: SparkSession, folder: str) -> list[str]:
    """Runs that were started and did not end, oldest first (their ids begin with a number)."""
    runs = try_read(spark, f"{folder}/runs")
    if runs is None:
        return []
    states = runs.groupBy("run_id").agg(F.count_if(F.col("state") == "ended").alias("ended"))
    return [r.run_id for r in states.filter("ended = 0").orderBy("run_id").collect()]


def start_run(todo: DataFrame, folder: str, rows_per_chunk: int) -> str | None:
    """Freeze the rows a run has to ask for; None if there are none.

    The run exists from the moment it is noted, after its rows are stored.
    """
    spark = todo.sparkSession
    runs = try_read(spark, f"{folder}/runs")
    number = 0 if runs is None else runs.select("run_id").distinct().count()
    run = f"{number:08d}-{uuid.uuid4().hex[:12]}"
    write_chunks(todo, ["complaint_id"], f"{folder}/run/{run}/work", rows_per_chunk)
    rows = read_table(spark, f"{folder}/run/{run}/work", todo.schema).count()  # the files' footers know it
    if not rows:
        return None
    _note(spark, folder, run, "started", rows)
    return run


def finish_run(
    spark: SparkSession, folder: str, run: str, hook: Hook, topics: str, chunks_per_batch: int = 1,
) -> RunCounts:
    """Ask for all rows of a run that have no stored attempts yet, and add its successes to ``topics``.

    Every step can be repeated: rows with stored attempts are left out, the resolved table is replaced, and only
    rows that ``topics`` lacks are appended.  Counts are taken in the jobs that write.
    """
    base = f"{folder}/run/{run}"
    work = read_table(spark, f"{base}/work").drop("_row", "_chunk")

    def filled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("narrative", F.coalesce("narrative", F.lit("")))

    def ask(rows: DataFrame) -> DataFrame:
        return run_hook(filled(rows), hook, RESPONSES, ASKED)

    paths = f"{base}/work", f"{base}/attempts", f"{base}/progress"
    beside = mounted(spark, f"{base}/slices")
    if beside:
        asked = filled(read_table(spark, paths[0])).select("_row", *ASKED)
        run_slices(spark, paths[0], asked, hook, RESPONSES, *paths[1:], beside, chunks_per_batch)
    else:
        run_chunks(spark, paths[0], work.schema, ask, *paths[1:], chunks_per_batch)
    ok, counted = F.col("extraction_ok"), Observation(f"run-{run}")
    answers = att.resolve_attempts(read_table(spark, f"{base}/attempts").drop("batch", "_first", "_last"))
    # A row the hook said nothing about is a failed one too.
    resolved = write_stage(
        joins.attach_results(work.select(*joins.RUN_KEY), answers, joins.RUN_KEY).observe(
            counted, F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("newly_processed"),
            F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
            F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        ), f"{base}/resolved")
    done = counted.get
    failed = (resolved.filter(~ok).select("complaint_id", F.coalesce("error", F.lit("no answer")).alias("error"))
              .orderBy("complaint_id").limit(fv.ERROR_SAMPLES).collect())
    joined = joins.attach_results(work, resolved.select(*joins.RUN_KEY, *ANSWER), joins.RUN_KEY)
    append_missing(joins.successful(joined).withColumn(
        "process_time", F.date_trunc("second", F.current_timestamp())), topics, joins.RUN_KEY)
    _note(spark, folder, run, "ended", done["attempted"])
    return RunCounts(done["attempted"], done["newly_processed"], done["prompt_tokens"], done["completion_tokens"],
                     tuple(r.error[: fv.MAX_ERROR_CHARS] for r in failed))


def extract_with_hook(
    chosen: DataFrame, folder: str, hook: Hook, resume: bool = True, rows_per_chunk: int = fv.CHECKPOINT_ROWS,
    chunks_per_batch: int = 1,
) -> tuple[DataFrame, RunCounts, int]:
    """Topics of ``chosen`` from a caller's model: the whole topics table, what was done, and how many rows
    of the data set it held before.

    ``chosen`` carries ``dataset_id``, ``complaint_id`` and ``narrative``.  Runs that an earlier call left are
    continued first, then the rows still missing make a run of their own; rows that failed for good in a run
    that ended are asked for again.  A batch holds ``rows_per_chunk * chunks_per_batch`` rows: that many calls
    a crash can cost, so on a cluster ``chunks_per_batch`` should be about the number of cores.
    """
    spark, topics = chosen.sparkSession, f"{folder}/topics"
    if not resume:
        for name, schema in (("runs", RUNS), ("topics", None)):
            held = try_read(spark, f"{folder}/{name}")
            if held is not None:
                spark.createDataFrame([], schema or held.schema).write.mode("overwrite").parquet(f"{folder}/{name}")
    counts = RunCounts()
    stored = try_read(spark, topics)
    before = 0 if stored is None else stored.join(chosen.select("dataset_id").limit(1), "dataset_id", "left_semi").count()
    todo = chosen
    for run in unfinished(spark, folder):
        counts = counts.plus(finish_run(spark, folder, run, hook, topics, chunks_per_batch))
        # Its failures have had their turn in this call.
        todo = joins.not_done(todo, read_table(spark, f"{folder}/run/{run}/resolved"))
    stored = try_read(spark, topics)
    run = start_run(todo if stored is None else joins.not_done(todo, stored), folder, rows_per_chunk)
    if run:
        counts = counts.plus(finish_run(spark, folder, run, hook, topics, chunks_per_batch))
    return read_table(spark, topics), counts, before
