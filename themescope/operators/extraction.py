"""Topics and sentiment of texts: a default extractor, and the hook for a model.

The default needs no service: recurring two-word phrases weighted by rarity are the topics, and
word lists decide the sentiment.  A caller's model is a function over pandas batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from themescope import fixed_values as fv
from themescope.functions.lists import each_item
from themescope.functions.nulls import or_empty
from themescope.session import scratch_path

# A model hook: batches of (complaint_id, text) in, batches of its output columns out.
Hook = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

# Default word lists; callers pass their own for other domains.
NEGATIVE_WORDS = ["denied", "error", "fail", "failed", "fraud", "never", "refused", "unable", "wrong", "worthless"]
POSITIVE_WORDS = ["great", "helpful", "pleased", "resolved", "satisfied", "thank", "thanks"]

_MIN_LETTERS = 4


def words_of(text: Column) -> Column:
    """Lower-case words of four letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(\p{{L}}{{{_MIN_LETTERS},}})"), F.lit(1))


def phrases_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """Two-word phrases per row, as an array column ``phrases``."""
    worded = df.select(key, words_of(or_empty(F.col(text))).alias("words"))
    return NGram(n=2, inputCol="words", outputCol="phrases").transform(worded)


def row_phrases(df: DataFrame, key: str, text: str) -> DataFrame:
    """How often each phrase stands in each text, as rows (key, phrase, _tf).

    Counted inside the row: the sorted phrases fall into runs of equal ones, so nothing is shuffled.
    """
    listed = phrases_of(df, key, text).select(key, F.array_sort("phrases").alias("_s"))
    places = F.transform("_s", lambda x, i: F.when((i == 0) | (x != F.get("_s", i - 1)), i))
    starts = listed.withColumn("_at", F.filter(places, lambda i: i.isNotNull()))
    runs = F.transform("_at", lambda at, i: F.struct(
        F.get("_s", at).alias("phrase"),
        (F.coalesce(F.get("_at", i + 1), F.size("_s")) - at).cast("bigint").alias("_tf")))
    told = starts.select(key, runs.alias("_run"))
    return each_item(told, "_run").select(key, "_run.phrase", "_run._tf")


def phrase_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """:func:`row_phrases`, stored."""
    told = row_phrases(df, key, text)
    path = scratch_path(df.sparkSession, "phrases")
    told.write.parquet(path)
    return df.sparkSession.read.schema(told.schema).parquet(path)


def rarity(told: DataFrame) -> DataFrame:
    """Rows per phrase, for phrases of more than one row; combined before the shuffle."""
    return told.groupBy("phrase").agg(F.count(F.lit(1)).alias("documents")).filter("documents > 1")


def rank_phrases(
    told: DataFrame, counts: DataFrame | None, rows: int, key: str, top: int = fv.MAX_TOPICS_PER_ROW
) -> DataFrame:
    """The phrases with the highest count x ln((rows + 1) / (rows with it + 1)) of each text.

    ``counts`` may leave out phrases of a single row.  The join on the phrase leaves a hot phrase to the
    skew handling of AQE.  Without ``counts`` all rows of a phrase are in ``told``: one exchange by phrase both counts
    and scores them, and counts are not moved.  A hot phrase is then one run of narrow rows, which the window may spill.
    """
    if counts is None:
        documents = F.count(F.lit(1)).over(W.partitionBy("phrase"))
        return _best_phrases(told.withColumn("documents", documents), rows, key, top)
    documents = F.coalesce("documents", F.lit(1))
    return _best_phrases(told.join(counts, "phrase", "left").withColumn("documents", documents), rows, key, top)


def _best_phrases(counted: DataFrame, rows: int, key: str, top: int) -> DataFrame:
    score = F.col("_tf") * F.ln((rows + 1.0) / (F.col("documents") + 1.0))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "phrase"))
    return (
        counted.withColumn("score", F.round(score, 6))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= top)
        .select(key, "phrase", "score", "rank")
    )


def key_phrases(
    df: DataFrame, key: str = "complaint_id", text: str = "narrative", top: int = fv.MAX_TOPICS_PER_ROW,
    corpus: DataFrame | None = None,
) -> DataFrame:
    """:func:`rank_phrases` of every text.

    Rows are counted exactly, in ``corpus`` if that is given (it holds the rows of ``df`` and may hold
    more), so a part ranks its phrases as the whole does.
    """
    rows = (df if corpus is None else corpus).agg(F.count(F.lit(1))).scalar()
    if corpus is None:
        return rank_phrases(row_phrases(df, key, text), None, rows, key, top)
    return rank_phrases(phrase_counts(df, key, text), rarity(phrase_counts(corpus, key, text)), rows, key, top)


def topic_lists(ranked: DataFrame, key: str = "complaint_id") -> DataFrame:
    """Ranked phrases as one topic list per row."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "phrase")))
    return ranked.groupBy(key).agg(listed.alias("_l")).select(
        key, F.col("_l.phrase").alias("all_topics_discussed")
    )


def lexicon_sentiment(
    text: Column, negative: list[str] = NEGATIVE_WORDS, positive: list[str] = POSITIVE_WORDS
) -> Column:
    """Negative if a negative word occurs, else Positive if a positive one does, else Neutral."""
    words = words_of(text)
    has = lambda listed: F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed]))
    return F.when(has(negative), "Negative").when(has(positive), "Positive").otherwise("Neutral")


def default_answers(df: DataFrame, key: str = "complaint_id", text: str = "narrative") -> DataFrame:
    """``df`` with all columns of a resolved model attempt but the topics."""
    return df.withColumns({
        "customer_sentiment": lexicon_sentiment(F.col(text)), "extraction_ok": F.lit(True),
        "supporting_quote": F.lit(""), "ai_topic_reasoning": F.lit(""), "model_version": F.lit("default"),
    })


def default_topics(
    df: DataFrame, key: str = "complaint_id", text: str = "narrative", corpus: DataFrame | None = None
) -> DataFrame:
    """Results of the default extractor in the shape of resolved model attempts; ``corpus`` as in :func:`key_phrases`."""
    answers = default_answers(df.select(key, text), key, text).drop(text)
    topics = topic_lists(key_phrases(df, key, text, corpus=corpus), key)
    return answers.join(topics, key, "left").withColumn("extraction_ok", F.col("all_topics_discussed").isNotNull())


def run_hook(df: DataFrame, hook: Hook, schema: str | StructType, columns: list[str]) -> DataFrame:
    """Run a caller's model over Arrow batches of the given columns."""
    return df.select(*columns).mapInPandas(hook, schema)
