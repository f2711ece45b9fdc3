"""Text vectors: a default vectoriser, the model hook, and the incremental feature table."""

from __future__ import annotations

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from themescope import fixed_values as fv
from themescope.functions.nulls import or_empty
from themescope.functions.text import token_estimate
from themescope.operators.batching import pack_batches
from themescope.operators.extraction import Hook
from themescope.schemas import FEATURES

FEATURE_KEY = ["complaint_id", "model", "text_hash"]


def hashed_tfidf(df: DataFrame, text: str, dimensions: int = 256, output: str = "embedding") -> DataFrame:
    """Unit-length TF-IDF vectors over hashed words; fitting is one aggregation of fixed width."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ]
    filled = df.withColumn(text, F.coalesce(text, F.lit("")))
    vectors = Pipeline(stages=stages).fit(filled).transform(filled)
    return vectors.withColumn(output, vector_to_array("_unit", "float32")).drop(
        "_words", "_tf", "_idf", "_unit"
    )


def with_feature_key(df: DataFrame, model: str, text: str = "narrative") -> DataFrame:
    """Identity of a vector: id, model and a digest of the text it was made from."""
    return df.withColumn("model", F.lit(model)).withColumn(
        "text_hash", F.sha2(F.coalesce(text, F.lit("")), 256)
    )


def missing_vectors(keyed: DataFrame, features: DataFrame) -> DataFrame:
    """Rows that have no stored vector for this very text and model."""
    return keyed.join(features.select(*FEATURE_KEY), FEATURE_KEY, "left_anti")


def cache_split(keyed: DataFrame, features: DataFrame) -> DataFrame:
    """Rows with (``hit``) and without a stored vector, in one row."""
    known = features.select(*FEATURE_KEY).distinct().withColumn("_hit", F.lit(1))
    return keyed.join(known, FEATURE_KEY, "left").agg(
        F.count("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses")
    )


def embed_with(
    df: DataFrame, hook: Hook, text: str = "narrative", max_items: int = fv.BATCH_ITEMS,
    max_tokens: int = fv.BATCH_TOKENS,
) -> DataFrame:
    """Vectors from a caller's model: it gets ``(complaint_id, model, text_hash, text)`` batches and
    yields ``(complaint_id, model, text_hash, embedding)``.

    Each batch it gets is one request: texts in order of their ids, at most ``max_items`` of them and
    ``max_tokens`` estimated tokens, or one longer text.  Batches are dealt over the tasks by their number.
    """
    keyed = df.select(*FEATURE_KEY, text)
    sized = keyed.select("complaint_id", token_estimate(or_empty(F.col(text))).alias("_tokens"))
    placed = pack_batches(sized, "complaint_id", "_tokens", max_items, max_tokens).select("complaint_id", "batch")

    def request(group: pd.DataFrame) -> pd.DataFrame:
        asked = group.drop(columns="batch").sort_values("complaint_id", ignore_index=True)
        return pd.concat(list(hook(iter([asked]))), ignore_index=True)[FEATURES.names]

    return keyed.join(placed, "complaint_id").groupBy("batch").applyInPandas(request, FEATURES)
