"""Recorded model attempts: which one counts, and what a run amounted to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from themescope import fixed_values as fv
from themescope.functions.responses import read_responses
from themescope.operators.joins import RUN_KEY


def is_retryable(status: Column, network_error: Column) -> Column:
    """Quota (429), server errors and network failures are worth another try; nothing else is."""
    quota = (status == 429) | status.between(500, 599)
    return F.coalesce(quota, F.lit(False)) | F.coalesce(network_error, F.lit(False))


def error_class(status: Column, error_type: Column, ok: Column) -> Column:
    """``ok``, ``retryable`` or ``fatal`` for one attempt."""
    network = error_type.isin("APIConnectionError", "APITimeoutError")
    return F.when(ok, "ok").when(is_retryable(status, network), "retryable").otherwise("fatal")


def judge_attempts(attempts: DataFrame) -> DataFrame:
    """Validate every raw response and add ``ok`` and ``error_class``."""
    judged = read_responses(attempts).withColumn(
        "ok", F.col("ok") & (F.coalesce("status", F.lit(200)) == 200) & F.col("error_type").isNull()
    )
    return judged.withColumn(
        "error_class", error_class(F.col("status"), F.col("error_type"), F.col("ok"))
    )


def resolve_attempts(
    attempts: DataFrame, per_model: int = fv.ATTEMPTS_PER_MODEL, keys: list[str] = RUN_KEY
) -> DataFrame:
    """One row per complaint: the first success along the model chain, or the last error.

    Models are tried in rank order, each up to ``per_model`` times; a fatal error ends a
    model's turn.  Recorded attempts that this order would never have made are ignored.  All of
    it happens after a single shuffle on the complaint key, and every complaint has at most
    (models x attempts) rows.
    """
    answer = ["topics", "supporting_quote", "reason", "sentiment", "prompt_tokens", "completion_tokens"]
    judged = judge_attempts(attempts.filter(F.col("attempt") < per_model)).repartition(*keys)
    order = F.struct("model_rank", "attempt")
    said = F.concat(
        F.col("model"), F.lit(" - "),
        F.coalesce("error_type", F.when(F.col("status") != 200, F.col("status").cast("string")),
                   F.lit("unusable response")),
    )
    turn = judged.groupBy(*keys, "model_rank").agg(
        F.min(F.when(F.col("error_class") == "fatal", F.col("attempt"))).alias("_fatal"),
        F.min_by(F.struct("attempt", "model", *answer), F.when(F.col("ok"), F.col("attempt"))).alias("_hit"),
        F.max_by(said, F.col("attempt")).alias("_last"),
        F.min_by(said, F.when(F.col("error_class") == "fatal", F.col("attempt"))).alias("_stop"),
    )
    served = F.col("_hit").isNotNull() & (
        F.col("_fatal").isNull() | (F.col("_hit.attempt") < F.col("_fatal"))
    )
    best = turn.groupBy(*keys).agg(
        F.min_by("_hit", F.when(served, F.col("model_rank"))).alias("_best"),
        F.max_by(F.coalesce("_stop", "_last"), F.col("model_rank")).alias("_error"),
    )
    ok = F.col("_best").isNotNull()
    return best.select(
        *keys,
        ok.alias("extraction_ok"),
        F.coalesce("_best.topics", F.array().cast("array<string>")).alias("all_topics_discussed"),
        F.coalesce("_best.supporting_quote", F.lit("")).alias("supporting_quote"),
        F.coalesce("_best.reason", F.lit("")).alias("ai_topic_reasoning"),
        F.coalesce("_best.sentiment", F.lit(fv.DEFAULT_SENTIMENT)).alias("customer_sentiment"),
        F.coalesce("_best.model", F.lit("")).alias("model_version"),
        F.coalesce("_best.prompt_tokens", F.lit(0)).alias("prompt_tokens"),
        F.coalesce("_best.completion_tokens", F.lit(0)).alias("completion_tokens"),
        F.when(~ok, F.col("_error")).alias("error"),
    )


def run_ledger(
    resolved: DataFrame, todo_rows: int | None = None, resumed_from: int = 0,
    order: str = "complaint_id",
) -> DataFrame:
    """What a run did, as one row counted from its results."""
    ok = F.col("extraction_ok")
    samples = (
        resolved.filter(~ok).orderBy(order).limit(fv.ERROR_SAMPLES)
        .agg(F.sort_array(F.collect_list(
            F.struct(order, F.substring("error", 1, fv.MAX_ERROR_CHARS).alias("error"))
        )).alias("s"))
        .select("s.error")
    )
    counted = resolved.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(ok).alias("newly_processed"),
        F.count_if(~ok).alias("failed"),
        F.sum(F.when(ok, F.size("all_topics_discussed")).otherwise(0)).cast("bigint").alias("total_topics"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )
    rows_in = F.col("attempted") + resumed_from if todo_rows is None else F.lit(todo_rows)
    return counted.select(
        rows_in.alias("rows_in"),
        (F.col("newly_processed") + resumed_from).alias("rows_out"),
        "newly_processed",
        F.lit(resumed_from).alias("resumed_from"),
        "failed", "total_topics", "prompt_tokens", "completion_tokens",
        F.array_join(samples.scalar(), "\n").alias("failure_samples"),
    )


def model_usage(resolved: DataFrame) -> DataFrame:
    """Complaints served per model."""
    return (
        resolved.filter("extraction_ok").groupBy("model_version")
        .agg(F.count(F.lit(1)).alias("served")).orderBy(F.desc("served"), "model_version")
    )
