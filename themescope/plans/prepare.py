"""Raw export to a balanced working set with held-out labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from themescope import fixed_values as fv
from themescope.functions.dates import parse_utc
from themescope.operators import preparation as prep, sampling


@dataclass(frozen=True)
class PrepareOptions:
    min_date: str = fv.MIN_DATE
    stratum_fraction: float = fv.STRATUM_FRACTION
    target: int = fv.SAMPLE_TARGET
    holdout_rows: int = fv.HOLDOUT_ROWS
    keep_words: int = fv.KEEP_WORDS
    seed: int = fv.SEED


@dataclass(frozen=True)
class WorkingSet:
    input: DataFrame
    truth: DataFrame
    holdout: DataFrame


def extraction_tests(min_date: str = fv.MIN_DATE) -> dict[str, Column]:
    """The tests a raw row has to pass, in order; also the stages of the funnel."""
    return {
        "has_text": F.col("`Consumer complaint narrative`").isNotNull(),
        "recent": parse_utc(F.col("`Date received`")) >= F.lit(min_date).cast("timestamp"),
    }


def extract_pool(raw: DataFrame, options: PrepareOptions = PrepareOptions()) -> DataFrame:
    """Rows with text, recent, and the dominant stratum thinned: filters only, no shuffle."""
    for test in extraction_tests(options.min_date).values():
        raw = raw.filter(test)
    stratum = prep.is_stratum(F.col("Product"))
    return sampling.thin_stratum(raw, stratum, options.stratum_fraction, "Complaint ID", options.seed)


def build_working_set(clean: DataFrame, options: PrepareOptions = PrepareOptions()) -> WorkingSet:
    """Balanced sample of clean complaints, truncated, split from its labels.

    ``clean`` is read several times: pass a stored table.
    """
    sample = sampling.balanced_sample(clean, "product", options.target, seed=options.seed)
    short = prep.truncate_text(sample, words=options.keep_words)
    seen, truth = prep.split_truth(sampling.shuffle_rows(short, seed=options.seed))
    return WorkingSet(seen, truth, sampling.holdout(truth, options.holdout_rows, seed=options.seed))
