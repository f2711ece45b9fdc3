"""Validation of model responses and resolution of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from themescope import fixed_values as fv
from themescope.catalog.registry import query, table, texts
from themescope.catalog.stand_ins import longest_words, sql_longest_words
from themescope.functions.responses import read_labels
from themescope.operators import attempts as att, joins

_WORDS = sql_longest_words("text", 7)

# One response per document and attempt: a model chain of two, two attempts each.  Status and
# shape follow from the text length.
ATTEMPTS = rf"""docs AS (SELECT doc_id, n_chars, lang, source, text, {_WORDS} AS w FROM documents),
slots AS (SELECT unnest([0, 0, 1, 1]) AS model_rank, unnest([0, 1, 0, 1]) AS attempt),
made AS (SELECT 'd' AS dataset_id, doc_id AS complaint_id, 'model-' || model_rank AS model, model_rank, attempt,
    CASE (n_chars + 3 * model_rank + attempt) % 6 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 ELSE 200 END AS status,
    CASE WHEN n_chars % 17 = 0 THEN 'APITimeoutError' END AS error_type,
    (n_chars + model_rank + 2 * attempt) % 8 AS shape, n_chars, lang, source, text, w FROM docs, slots),
attempts AS (SELECT dataset_id, complaint_id, model, model_rank, attempt, status, error_type,
    CASE shape
      WHEN 0 THEN CAST(to_json({{topics: w, supporting_quote: text, reason: source, sentiment: CASE lang WHEN 'en' THEN 'Negative' WHEN 'fr' THEN 'negative' ELSE 'Positive' END}}) AS VARCHAR)
      WHEN 1 THEN CAST(to_json(w) AS VARCHAR)
      WHEN 2 THEN '[' || n_chars || ',' || CAST(to_json({{topics: w, sentiment: 'Neutral'}}) AS VARCHAR) || ']'
      WHEN 3 THEN CAST(to_json(source) AS VARCHAR)
      WHEN 4 THEN '{{"topics": [' || n_chars || ', null, "  ", " a ", "a"], "sentiment": "Positive"}}'
      WHEN 5 THEN '{{"topics": ["' || source || '"'
      WHEN 6 THEN '{{"topics": ["  ", ""]}}'
      END AS raw, n_chars AS prompt_tokens, shape AS completion_tokens FROM made)"""

# The validation rules over JSON functions.
VALID = rf"""parsed AS (SELECT *, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM attempts),
answered AS (SELECT *, CASE json_type(j) WHEN 'OBJECT' THEN j WHEN 'ARRAY'
    THEN list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) = 'OBJECT')[1] END AS answer FROM parsed),
listed AS (SELECT *, CASE WHEN answer IS NOT NULL THEN json_extract_string(answer, '$.topics[*]')
    WHEN json_type(j) = 'ARRAY' THEN json_extract_string(j, '$[*]') END AS found FROM answered),
stripped AS (SELECT *, list_filter(list_transform(found, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS kept FROM listed),
ordered AS (SELECT *, list_filter(kept, lambda x, i: list_position(kept, x) = i)[1:{fv.MAX_TOPICS_PER_ROW}] AS topics FROM stripped),
valid AS (SELECT dataset_id, complaint_id, model, model_rank, attempt, status, error_type, prompt_tokens, completion_tokens,
    coalesce(len(topics) > 0, false) AS usable, len(topics) AS n_topics, array_to_string(topics, '|') AS topics,
    substr(coalesce(json_extract_string(answer, '$.supporting_quote'), ''), 1, {fv.MAX_QUOTE_CHARS}) AS supporting_quote,
    coalesce(json_extract_string(answer, '$.reason'), '') AS reason,
    CASE WHEN list_contains({fv.SENTIMENTS}, json_extract_string(answer, '$.sentiment'))
         THEN json_extract_string(answer, '$.sentiment') ELSE '{fv.DEFAULT_SENTIMENT}' END AS sentiment FROM ordered),
graded AS (SELECT *, usable AND coalesce(status, 200) = 200 AND error_type IS NULL AS ok FROM valid),
classed AS (SELECT *, CASE WHEN ok THEN 'ok' WHEN status = 429 OR status BETWEEN 500 AND 599
    OR coalesce(error_type IN ('APIConnectionError', 'APITimeoutError'), false) THEN 'retryable' ELSE 'fatal' END AS error_class FROM graded)"""

RESOLVED = f"""turn AS (SELECT *, min(CASE WHEN error_class = 'fatal' THEN attempt END) OVER (PARTITION BY complaint_id, model_rank) AS fatal,
    model || ' - ' || coalesce(error_type, CASE WHEN status <> 200 THEN CAST(status AS VARCHAR) END, 'unusable response') AS said FROM classed),
live AS (SELECT * FROM turn WHERE fatal IS NULL OR attempt <= fatal),
best AS (SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY ok DESC, CASE WHEN ok THEN model_rank ELSE -model_rank END,
    CASE WHEN ok THEN attempt ELSE -attempt END) AS rn FROM live),
resolved AS (SELECT complaint_id, ok AS extraction_ok, CASE WHEN ok THEN topics ELSE '' END AS topics,
    CASE WHEN ok THEN sentiment ELSE '{fv.DEFAULT_SENTIMENT}' END AS customer_sentiment,
    CASE WHEN ok THEN model ELSE '' END AS model_version,
    CASE WHEN ok THEN prompt_tokens ELSE 0 END AS prompt_tokens, CASE WHEN ok THEN completion_tokens ELSE 0 END AS completion_tokens,
    CASE WHEN NOT ok THEN said END AS error, n_topics FROM best WHERE rn = 1)"""


def _json(**fields: Column | str) -> Column:
    return F.to_json(F.struct(*[F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in fields.items()]))


def model_attempts(spark: SparkSession, folder: str) -> DataFrame:
    slots = F.array(*[
        F.struct(F.lit(r).alias("model_rank"), F.lit(a).alias("attempt")) for r in (0, 1) for a in (0, 1)
    ])
    made = texts(spark, folder).withColumn("w", longest_words(F.col("text"), 7)).withColumn("s", F.explode(slots)).select("*", "s.*")
    turn = (F.col("n_chars") + 3 * F.col("model_rank") + F.col("attempt")) % 6
    shape = (F.col("n_chars") + F.col("model_rank") + 2 * F.col("attempt")) % 8
    mood = F.when(F.col("lang") == "en", "Negative").when(F.col("lang") == "fr", "negative").otherwise("Positive")
    chars = F.col("n_chars").cast("string")
    raw = (
        F.when(shape == 0, _json(topics="w", supporting_quote="text", reason="source", sentiment=mood))
        .when(shape == 1, F.to_json("w"))
        .when(shape == 2, F.concat(F.lit("["), chars, F.lit(","), _json(topics="w", sentiment=F.lit("Neutral")), F.lit("]")))
        .when(shape == 3, F.concat(F.lit('"'), F.col("source"), F.lit('"')))
        .when(shape == 4, F.concat(F.lit('{"topics": ['), chars, F.lit(', null, "  ", " a ", "a"], "sentiment": "Positive"}')))
        .when(shape == 5, F.concat(F.lit('{"topics": ["'), F.col("source"), F.lit('"')))
        .when(shape == 6, '{"topics": ["  ", ""]}')
    )
    return made.select(
        F.lit("d").alias("dataset_id"), F.col("doc_id").alias("complaint_id"),
        F.concat(F.lit("model-"), F.col("model_rank").cast("string")).alias("model"), "model_rank", "attempt",
        F.when(turn == 0, 429).when(turn == 1, 503).when(turn == 2, 404).otherwise(200).alias("status"),
        F.when(F.col("n_chars") % 17 == 0, "APITimeoutError").alias("error_type"),
        raw.alias("raw"), F.col("n_chars").alias("prompt_tokens"), shape.alias("completion_tokens"),
    )


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return att.resolve_attempts(model_attempts(spark, folder))


@query("response_validation", f"""WITH {ATTEMPTS}, {VALID}
SELECT complaint_id, model_rank, attempt, ok, error_class, CASE WHEN usable THEN topics END AS topics,
       supporting_quote, reason, sentiment FROM classed""")
def response_validation(spark: SparkSession, folder: str) -> DataFrame:
    return att.judge_attempts(model_attempts(spark, folder)).select(
        "complaint_id", "model_rank", "attempt", "ok", "error_class",
        F.array_join("topics", "|").alias("topics"), "supporting_quote", "reason", "sentiment",
    )


@query("attempt_resolution", f"WITH {ATTEMPTS}, {VALID}, {RESOLVED} SELECT * EXCLUDE (n_topics) FROM resolved")
def attempt_resolution(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder).select(
        "complaint_id", "extraction_ok", F.array_join("all_topics_discussed", "|").alias("topics"),
        "customer_sentiment", "model_version", "prompt_tokens", "completion_tokens", "error",
    )


@query("run_ledger", f"""WITH {ATTEMPTS}, {VALID}, {RESOLVED},
errors AS (SELECT string_agg(substr(error, 1, {fv.MAX_ERROR_CHARS}), chr(10) ORDER BY complaint_id) AS s FROM (
  SELECT complaint_id, error FROM resolved WHERE NOT extraction_ok ORDER BY complaint_id LIMIT {fv.ERROR_SAMPLES}))
SELECT count(*) AS rows_in, count(*) FILTER (extraction_ok) AS rows_out, count(*) FILTER (extraction_ok) AS newly_processed,
       0 AS resumed_from, count(*) FILTER (NOT extraction_ok) AS failed,
       CAST(sum(CASE WHEN extraction_ok THEN n_topics ELSE 0 END) AS BIGINT) AS total_topics,
       CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
       (SELECT s FROM errors) AS failure_samples FROM resolved""")
def run_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return att.run_ledger(_resolved(spark, folder))


@query("model_usage", f"""WITH {ATTEMPTS}, {VALID}, {RESOLVED}
SELECT model_version, count(*) AS served FROM resolved WHERE extraction_ok GROUP BY 1""")
def model_usage(spark: SparkSession, folder: str) -> DataFrame:
    return att.model_usage(_resolved(spark, folder))


@query("attached_results", f"""WITH {ATTEMPTS}, {VALID}, {RESOLVED}
SELECT d.doc_id AS complaint_id, d.source, coalesce(topics, '') AS topics, model_version
FROM documents d JOIN resolved ON doc_id = complaint_id WHERE extraction_ok""")
def attached_results(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("complaint_id"), "source")
    joined = joins.attach_results(rows, _resolved(spark, folder).drop("dataset_id"), ["complaint_id"])
    return joins.successful(joined).select(
        "complaint_id", "source", F.array_join("all_topics_discussed", "|").alias("topics"), "model_version"
    )


@query("run_columns", "SELECT doc_id, 'm-1' AS model_version, true AS stamped FROM documents")
def run_columns(spark: SparkSession, folder: str) -> DataFrame:
    stamped = joins.with_run_columns(table(spark, folder, "documents").select("doc_id"), "m-1")
    whole = F.col("process_time") == F.date_trunc("second", "process_time")
    return stamped.select("doc_id", "model_version", whole.alias("stamped"))


@query("label_responses", r"""WITH r AS (SELECT doc_id, source, n_chars % 5 AS shape FROM documents)
SELECT doc_id, CASE shape WHEN 0 THEN 'Theme of ' || source WHEN 1 THEN source END AS label FROM r""")
def label_responses(spark: SparkSession, folder: str) -> DataFrame:
    shape = F.col("n_chars") % 5
    name = F.col("source")
    raw = (
        F.when(shape == 0, F.concat(F.lit('{"label": "  Theme of '), name, F.lit(' "}')))
        .when(shape == 1, F.concat(F.lit('[7, {"label": "'), name, F.lit('"}]')))
        .when(shape == 2, F.concat(F.lit('["'), name, F.lit('"]')))
        .when(shape == 3, '{"label": "   "}')
    )
    return read_labels(table(spark, folder, "documents").select("doc_id", raw.alias("raw"))).select("doc_id", "label")


@query("repeated_words", r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
f AS (SELECT doc_id, word, min(i) AS i FROM u GROUP BY 1, 2)
SELECT doc_id, md5(string_agg(word, ' ' ORDER BY i)) AS digest, count(*) AS words FROM f GROUP BY 1""")
def repeated_words(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " ")
    once = texts(spark, folder).select("doc_id", F.array_distinct(words).alias("w"))
    return once.select(
        "doc_id", F.md5(F.array_join("w", " ")).alias("digest"), F.size("w").cast("bigint").alias("words")
    )
