"""Topics, cluster samples and names, and the hooks for models."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope import fixed_values as fv
from themescope.catalog import stand_ins as si
from themescope.catalog.registry import query, table, texts
from themescope.operators import batching, embedding, extraction as ex, naming, ordering
from themescope.functions import text as tx
from themescope.plans.label_runs import label_with_hook
from themescope.plans.full_run import RunOptions, extract_topics, ledger_table, run_all
from themescope.session import scratch_path

_PHRASES = rf"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '(\p{{L}}{{4,}})', 1) AS w FROM documents),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w),
tf AS (SELECT doc_id, phrase, count(*) AS tf FROM p GROUP BY 1, 2),
df AS (SELECT phrase, count(*) AS documents FROM tf GROUP BY 1),
s AS (SELECT doc_id, phrase, round(tf * ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (documents + 1.0::DOUBLE)), 6) AS score FROM tf JOIN df USING (phrase)),
phrases AS (SELECT doc_id, phrase, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS INTEGER) AS rank FROM s)"""


@query("key_phrases", f"WITH {_PHRASES} SELECT doc_id, phrase, score, rank FROM phrases WHERE rank <= {fv.MAX_TOPICS_PER_ROW}")
def key_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return ex.key_phrases(texts(spark, folder), "doc_id", "text")


_LEXICON = rf"""CASE WHEN list_has_any(regexp_extract_all(lower(text), '(\p{{L}}{{4,}})', 1), {ex.NEGATIVE_WORDS}) THEN 'Negative'
  WHEN list_has_any(regexp_extract_all(lower(text), '(\p{{L}}{{4,}})', 1), {ex.POSITIVE_WORDS}) THEN 'Positive' ELSE 'Neutral' END"""


@query("lexicon_sentiment", f"SELECT {_LEXICON} AS sentiment, count(*) AS n FROM documents GROUP BY 1")
def lexicon_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).select(ex.lexicon_sentiment(F.col("text")).alias("sentiment"))
    return docs.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))


@query("default_topics", f"""WITH {_PHRASES},
l AS (SELECT doc_id, string_agg(phrase, '|' ORDER BY rank) AS topics FROM phrases WHERE rank <= {fv.MAX_TOPICS_PER_ROW} GROUP BY 1)
SELECT doc_id, {_LEXICON} AS customer_sentiment, topics IS NOT NULL AS extraction_ok, topics
FROM documents LEFT JOIN l USING (doc_id)""")
def default_topics(spark: SparkSession, folder: str) -> DataFrame:
    return ex.default_topics(texts(spark, folder), "doc_id", "text").select(
        "doc_id", "customer_sentiment", "extraction_ok", F.array_join("all_topics_discussed", "|").alias("topics")
    )


_SEEN = f"""{si.TOPIC_ROWS}, x AS (
  SELECT cluster_id, complaint_id, unnest(all_topics_discussed) AS topic, generate_subscripts(all_topics_discussed, 1) AS pos FROM topic_rows),
seen AS (SELECT cluster_id, topic, count(*) AS n, min(complaint_id * 10 + pos) AS first_seen FROM x GROUP BY 1, 2)"""


@query("topics_per_cluster", f"WITH {_SEEN} SELECT cluster_id, topic, n FROM seen")
def topics_per_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return naming.cluster_topics(si.topic_rows(spark, folder)).select("cluster_id", "topic", "n")


@query("topic_samples", f"""WITH {_SEEN}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY first_seen) AS rn FROM seen)
SELECT cluster_id, string_agg(topic, '{fv.TOPIC_SEPARATOR}' ORDER BY rn) AS sample_topics, count(*) AS sampled
FROM r WHERE rn <= {fv.SAMPLE_TOPICS} GROUP BY 1""")
def topic_samples(spark: SparkSession, folder: str) -> DataFrame:
    return naming.topic_samples(si.topic_rows(spark, folder))


_LABELS = f"""{_SEEN}, c AS (SELECT topic, count(*) AS clusters FROM seen GROUP BY 1),
scored AS (SELECT cluster_id, topic, round(n * ln(1.0::DOUBLE + (SELECT count(DISTINCT cluster_id) FROM topic_rows) / clusters), 6) AS score
           FROM seen JOIN c USING (topic)),
labels AS (SELECT cluster_id, topic AS label, score FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, topic) AS rn FROM scored) WHERE rn = 1)"""


@query("distinctive_labels", f"WITH {_LABELS} SELECT * FROM labels")
def distinctive_labels(spark: SparkSession, folder: str) -> DataFrame:
    return naming.distinctive_labels(si.topic_rows(spark, folder))


@query("labelled_rows", f"""WITH {_LABELS}
SELECT complaint_id, coalesce(CASE WHEN cluster_id < 15 THEN label END, '{fv.FALLBACK_LABEL}' || cluster_id) AS general_topic_l1,
       array_to_string(all_topics_discussed, '{fv.TOPIC_SEPARATOR}') AS topic_discussed
FROM topic_rows LEFT JOIN labels USING (cluster_id)""")
def labelled_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = si.topic_rows(spark, folder)
    labels = naming.distinctive_labels(rows).withColumn("label", F.when(F.col("cluster_id") < 15, F.col("label")))
    return naming.label_rows(rows, labels).select("complaint_id", "general_topic_l1", "topic_discussed")


def _letter_vector(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for an embedding model: text length and counts of three letters."""
    for batch in batches:
        counts = [batch["text"].str.len()] + [batch["text"].str.count(letter) for letter in "aes"]
        vectors = pd.concat(counts, axis=1).astype("float32").to_numpy()
        yield batch.drop(columns="text").assign(embedding=list(vectors))


@query("model_hook", """SELECT doc_id AS complaint_id, 'letters' AS model,
  (length(text) + 2 * (length(text) - length(replace(text, 'a', ''))) + 3 * (length(text) - length(replace(text, 'e', '')))
   + 5 * (length(text) - length(replace(text, 's', ''))))::DOUBLE AS weighted FROM documents""")
def model_hook(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).select(F.col("doc_id").alias("complaint_id"), "text")
    vectors = embedding.embed_with(embedding.with_feature_key(docs, "letters", "text"), _letter_vector, "text")
    parts = [F.get("embedding", F.lit(i)).cast("double") * w for i, w in enumerate((1, 2, 3, 5))]
    return vectors.select("complaint_id", "model", sum(parts[1:], parts[0]).alias("weighted"))


_BATCHES = f"""r AS (
  SELECT doc_id, greatest(1, length(text) // {fv.CHARS_PER_TOKEN}) AS tokens, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
b AS (SELECT doc_id, tokens, i, 0::BIGINT AS batch, 1 AS items, tokens AS used FROM r WHERE i = 1
  UNION ALL SELECT r.doc_id, r.tokens, r.i,
    CASE WHEN items >= {fv.BATCH_ITEMS} OR used + r.tokens > {fv.BATCH_TOKENS} THEN batch + 1 ELSE batch END,
    CASE WHEN items >= {fv.BATCH_ITEMS} OR used + r.tokens > {fv.BATCH_TOKENS} THEN 1 ELSE items + 1 END,
    CASE WHEN items >= {fv.BATCH_ITEMS} OR used + r.tokens > {fv.BATCH_TOKENS} THEN r.tokens ELSE used + r.tokens END
  FROM b JOIN r ON r.i = b.i + 1)"""


@query("token_batches", f"WITH RECURSIVE {_BATCHES} SELECT doc_id, tokens, batch FROM b")
def token_batches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))
    return batching.pack_batches(docs, "doc_id", "tokens")


def _request_size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for an embedding model: how many texts and estimated tokens each request held."""
    for batch in batches:
        tokens = (batch["text"].str.len() // fv.CHARS_PER_TOKEN).clip(lower=1)
        size = [float(len(batch)), float(tokens.sum()), float(tokens.max())]
        yield batch.drop(columns="text").assign(embedding=[size] * len(batch))


@query("token_fed_hook", f"""WITH RECURSIVE {_BATCHES}
SELECT doc_id AS complaint_id, CAST(count(*) OVER w AS BIGINT) AS items, CAST(sum(tokens) OVER w AS BIGINT) AS used,
       count(*) OVER w <= {fv.BATCH_ITEMS} AND (sum(tokens) OVER w <= {fv.BATCH_TOKENS} OR count(*) OVER w = 1) AS within
FROM b WINDOW w AS (PARTITION BY batch)""")
def token_fed_hook(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("complaint_id"), "text")
    vectors = embedding.embed_with(embedding.with_feature_key(docs, "sizes", "text"), _request_size, "text")
    items, used = (F.get("embedding", F.lit(i)).cast("bigint") for i in (0, 1))
    within = (items <= fv.BATCH_ITEMS) & ((used <= fv.BATCH_TOKENS) | (items == 1))
    return vectors.select("complaint_id", items.alias("items"), used.alias("used"), within.alias("within"))


def _names_with_trouble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for two naming models: over quota, gone, slow to start, silent, or fine, by cluster."""
    for batch in batches:
        out = []
        for row in batch.itertuples():
            kind = row.cluster_id % 8
            if row.model == "first" and (kind in (0, 4) or kind == 3 and row.attempt == 0):
                out.append((row.cluster_id, 429, "RateLimitError", None))
            elif row.model == "first" and kind in (1, 5):
                out.append((row.cluster_id, 404, "NotFoundError", None))
            elif row.model == "second" and kind == 4:
                out.append((row.cluster_id, 200, None, '{"label": " "}'))
            elif kind != 6 or row.model == "second":
                out.append((row.cluster_id, 200, None, json.dumps({"label": f" {row.model}: {row.sampled} "})))
        yield pd.DataFrame(out, columns=["cluster_id", "status", "error_type", "raw"])


@query("cluster_names", f"""WITH {_SEEN}, c AS (SELECT cluster_id, least(count(*), {fv.SAMPLE_TOPICS}) AS sampled FROM seen GROUP BY 1),
k AS (SELECT *, cluster_id % 8 AS kind FROM c)
SELECT cluster_id, CASE WHEN kind = 4 THEN '{fv.FALLBACK_LABEL}' || cluster_id WHEN kind IN (0, 1, 5, 6) THEN 'second: ' || sampled
            ELSE 'first: ' || sampled END AS label,
       CASE WHEN kind = 4 THEN NULL WHEN kind IN (0, 1, 5, 6) THEN 'second' ELSE 'first' END AS model,
       CAST(CASE WHEN kind IN (0, 4) THEN 3 WHEN kind IN (1, 3, 5, 6) THEN 2 ELSE 1 END AS BIGINT) AS attempts,
       CASE WHEN kind = 4 THEN 'second - unusable response' END AS error FROM k""")
def cluster_names(spark: SparkSession, folder: str) -> DataFrame:
    samples = naming.topic_samples(si.topic_rows(spark, folder))
    named = label_with_hook(samples, _names_with_trouble, scratch_path(spark, "names"), ("first", "second"))
    return named.withColumn("label", naming.or_fallback(F.col("label"), F.col("cluster_id")))


@query("checkpoint_chunks", f"""SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // {fv.CHECKPOINT_ROWS} AS BIGINT) AS chunk FROM documents""")
def checkpoint_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.with_chunks(table(spark, folder, "documents").select("doc_id"), ["doc_id"])


@query("first_rows", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ordering.first_rows(table(spark, folder, "documents").select("doc_id", "source"), ["doc_id"], 50)


@query("full_run")
def full_run(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).select(
        F.col("doc_id").alias("complaint_id"), F.col("text").alias("narrative"), F.col("source").alias("product"),
        F.date_add(F.lit("2023-01-01").cast("date"), (F.col("n_chars") % 900).cast("int")).alias("date"),
    )
    options = RunOptions(scratch_path(spark, "full-run"), kmeans_starts=2, max_iter=10)
    return ledger_table(spark, run_all(docs, options).ledger)


_FIXED_MEASURES = ["rows_in", "rows_out", "resumed_from", "newly_processed", "failed", "total_topics", "complaints",
                   "clusters", "unique_topics", "output_rows", "input_rows"]


@query("full_run_ledger", f"""WITH {_PHRASES}, k AS (SELECT * FROM phrases WHERE rank <= {fv.MAX_TOPICS_PER_ROW}),
n AS (SELECT (SELECT count(*) FROM documents) AS docs, count(DISTINCT doc_id) AS found, count(*) AS topics,
             count(DISTINCT phrase) AS kinds FROM k)
SELECT unnest(['extract_topics', 'extract_topics', 'extract_topics', 'extract_topics', 'extract_topics', 'extract_topics',
               'cluster_topics', 'cluster_topics', 'cluster_topics', 'label_clusters', 'generate_insights']) AS step,
       unnest({_FIXED_MEASURES}) AS measure,
       CAST(unnest([docs, found, 0, found, docs - found, topics, found, {fv.N_CLUSTERS}, kinds, found, found]) AS VARCHAR) AS value
FROM n""")
def full_run_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The measures of a whole run that do not depend on fitted clusters."""
    return full_run(spark, folder).filter(F.col("measure").isin(_FIXED_MEASURES))


def _first_and_last_word(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A stand-in for a model: the first and the last word of a text are its topics; it costs a token a word."""
    for batch in batches:
        words = [re.findall(r"[^ \t\n\r]+", text) for text in batch["narrative"]]
        yield batch.drop(columns="narrative").assign(
            model="words", model_rank=0, attempt=0, status=200, error_type=None,
            raw=[json.dumps({"topics": [w[0], w[-1]]} if w else {}) for w in words],
            prompt_tokens=[len(w) for w in words], completion_tokens=2)


def _dies_late(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same model in a process that ends in the middle of the table."""
    for batch in batches:
        if (batch["complaint_id"] >= 150).any():
            raise RuntimeError("the service is gone")
        yield from _first_and_last_word(iter([batch]))


@query("resumed_run", r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents)
SELECT doc_id AS complaint_id, CASE WHEN w[1] = w[-1] THEN w[1] ELSE w[1] || '|' || w[-1] END AS topics,
       CAST(1 AS BIGINT) AS attempts, CAST(len(w) AS BIGINT) AS prompt_tokens FROM w WHERE len(w) > 0""")
def resumed_run(spark: SparkSession, folder: str) -> DataFrame:
    """A run whose model dies, continued by a second call: every row is asked for once in all."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("complaint_id"), F.col("text").alias("narrative"))
    base = scratch_path(spark, "resumed-run")
    try:
        extract_topics(docs, RunOptions(base, extract_hook=_dies_late, commit_rows=25))
    except Exception as error:  # noqa: BLE001 - whatever way the engine reports the death of a task
        if "the service is gone" not in str(error):
            raise
    topics, _ = extract_topics(docs, RunOptions(base, extract_hook=_first_and_last_word, commit_chunks=4))
    asked = spark.read.parquet(f"{base}/run/*/attempts").groupBy("complaint_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("prompt_tokens").alias("prompt_tokens"))
    listed = F.array_join("all_topics_discussed", "|").alias("topics")
    return topics.select("complaint_id", listed).join(asked, "complaint_id")


@query("topics_in_two_calls", f"""WITH {_PHRASES}
SELECT doc_id AS complaint_id, string_agg(phrase, '|' ORDER BY rank) AS topics FROM phrases
WHERE rank <= {fv.MAX_TOPICS_PER_ROW} GROUP BY 1""")
def topics_in_two_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The default extractor over the English documents, then over all: the end is that of one call."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("complaint_id"), F.col("text").alias("narrative"), "lang")
    options = RunOptions(scratch_path(spark, "two-calls"))
    extract_topics(docs.filter("lang = 'en'"), options)
    topics, _ = extract_topics(docs, options)
    return topics.select("complaint_id", F.array_join("all_topics_discussed", "|").alias("topics"))
