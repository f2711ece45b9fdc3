"""Names for clusters from a caller's model, with a chain of models and repeated attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from themescope import fixed_values as fv
from themescope.functions.responses import read_labels
from themescope.operators.attempts import error_class
from themescope.operators.extraction import Hook
from themescope.sources.writers import write_stage

ANSWERS = "cluster_id int, status int, error_type string, raw string"


def _with_defaults(hook: Hook) -> Hook:
    """A hook may leave out status and error type where nothing went wrong."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for answers in hook(batches):
            yield pd.DataFrame({
                "cluster_id": answers["cluster_id"], "status": answers.get("status", 200),
                "error_type": answers.get("error_type"), "raw": answers["raw"],
            })

    return run


def label_with_hook(
    samples: DataFrame, hook: Hook, folder: str, models: tuple[str, ...] = ("default",),
    per_model: int = fv.ATTEMPTS_PER_MODEL,
) -> DataFrame:
    """``(cluster_id, label, model, attempts, error)``; label is NULL where every model failed.

    The hook gets ``(cluster_id, sample_topics, sampled, model, attempt)`` and yields ``ANSWERS``.  Each turn
    asks only for clusters without a name: again with the same model after a quota, server or network error
    while it has attempts left, else with the next model.  The answers of every turn are stored before they
    are judged, so no call is made twice.  There are at most models x attempts turns.
    """
    chain = F.array(*[F.lit(m) for m in models])
    place = F.lit(0).alias("model_rank"), F.lit(0).alias("attempt")
    pending = write_stage(samples.select("cluster_id", "sample_topics", "sampled", *place), f"{folder}/pending-0")
    judged = None
    for turn in range(len(models) * per_model):
        asked = pending.withColumn("model", F.element_at(chain, F.col("model_rank") + 1))
        answers = asked.select("cluster_id", "sample_topics", "sampled", "model", "attempt").mapInPandas(
            _with_defaults(hook), ANSWERS)
        said = write_stage(answers, f"{folder}/responses/turn={turn}")
        # A cluster the hook was silent about has an unusable answer.
        rows = read_labels(asked.join(said, "cluster_id", "left"))
        ok = F.col("label").isNotNull() & (F.coalesce("status", F.lit(200)) == 200) & F.col("error_type").isNull()
        what = F.coalesce("error_type", F.when(F.col("status") != 200, F.col("status").cast("string")),
                          F.lit("unusable response"))
        rows = rows.withColumns({
            "_class": error_class(F.col("status"), F.col("error_type"), ok), "turn": F.lit(turn),
            "error": F.when(~ok, F.concat("model", F.lit(" - "), what)), "label": F.when(ok, F.col("label")),
        })
        rows = write_stage(rows.drop("raw"), f"{folder}/judged/turn={turn}")
        judged = rows if judged is None else judged.unionByName(rows)
        again = (F.col("_class") == "retryable") & (F.col("attempt") + 1 < per_model)
        left = (
            rows.filter(F.col("_class") != "ok")
            .withColumns({"model_rank": F.when(again, F.col("model_rank")).otherwise(F.col("model_rank") + 1),
                          "attempt": F.when(again, F.col("attempt") + 1).otherwise(0)})
            .filter(F.col("model_rank") < len(models)).select(*pending.columns)
        )
        pending = write_stage(left, f"{folder}/pending-{turn + 1}")
        if not pending.take(1):
            break
    last = judged.groupBy("cluster_id").agg(
        F.max_by(F.struct("label", "model", "error"), "turn").alias("_last"), F.count(F.lit(1)).alias("attempts"))
    return last.select(
        "cluster_id", "_last.label", F.when(F.col("_last.label").isNotNull(), F.col("_last.model")).alias("model"),
        "attempts", "_last.error")
