"""Joins of predictions, truth, results and earlier output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from themescope import fixed_values as fv

RUN_KEY = ["dataset_id", "complaint_id"]


def not_done(todo: DataFrame, done: DataFrame, keys: list[str] = RUN_KEY) -> DataFrame:
    """Rows that earlier output does not hold yet.

    The data set is part of the key: ids made up for one upload mean nothing in another.
    """
    return todo.join(done.select(*keys), keys, "left_anti")


def unique_truth(truth: DataFrame, key: str = "complaint_id", order: str | None = None) -> DataFrame:
    """One row per key.  With ``order`` the last duplicate wins; without it duplicates are an error
    when the rows are read."""
    labels = [c for c in truth.columns if c not in (key, order)]
    if order:
        last = F.max_by(F.struct(*labels), F.col(order)).alias("_last")
        return truth.groupBy(key).agg(last).select(key, "_last.*")
    first = F.first(F.struct(*labels)).alias("_first")
    message = F.concat(F.lit(f"truth holds {key} more than once: "), F.col(key).cast("string"))
    checked = truth.groupBy(key).agg(first, F.count(F.lit(1)).alias("_n"))
    row = F.when(F.col("_n") == 1, F.col("_first")).otherwise(F.raise_error(message))
    return checked.select(key, row.alias("_row")).select(key, "_row.*")


def with_truth(
    predicted: DataFrame, truth: DataFrame, label: str, key: str = "complaint_id", how: str = "inner"
) -> DataFrame:
    """Predictions with their true label; a column of the same name on the left gives way."""
    return predicted.drop(label).join(unique_truth(truth.select(key, label), key), key, how)


def last_truth(
    ids: DataFrame, truth: DataFrame, label: str, order: str, key: str = "complaint_id"
) -> DataFrame:
    """Look each id up, NULL when unknown; of duplicate truth rows the last one counts."""
    return ids.drop(label).join(unique_truth(truth.select(key, order, label), key, order), key, "left")


def attach_results(rows: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Put extraction results on their rows; a row without a result is a failed one."""
    joined = rows.join(results, keys, "left")
    return joined.withColumn("extraction_ok", F.coalesce("extraction_ok", F.lit(False)))


def with_run_columns(df: DataFrame, model: str) -> DataFrame:
    """Stamp rows with the UTC second of the run and the model that served them."""
    return df.withColumns({
        "process_time": F.date_trunc("second", F.current_timestamp()),
        "model_version": F.lit(model),
    })


def successful(df: DataFrame) -> DataFrame:
    return df.filter("extraction_ok")


def truth_match(
    predicted: DataFrame, truth: DataFrame, key: str = "complaint_id", share: float = fv.MATCH_SHARE
) -> DataFrame:
    """Do the predictions come from the data the truth is about?

    One row: distinct predicted ids, those known to the truth, their share and the verdict.
    Both sides are reduced to distinct ids, so duplicates and hot ids cost nothing in the join.
    """
    ids = predicted.select(key).filter(F.col(key).isNotNull()).distinct()
    known = truth.select(key).distinct().withColumn("_known", F.lit(1))
    counted = ids.join(known, key, "left").agg(
        F.count(F.lit(1)).alias("predicted_ids"), F.count("_known").alias("matched_ids")
    )
    ratio = F.when(F.col("predicted_ids") > 0, F.col("matched_ids") / F.col("predicted_ids"))
    return counted.withColumn("match_share", F.coalesce(ratio, F.lit(0.0))).withColumn(
        "matches", F.col("match_share") > F.lit(share)
    )


def common_ids(predicted: DataFrame, truth: DataFrame, key: str = "complaint_id") -> DataFrame:
    return predicted.select(key).intersect(truth.select(key))
