"""Reading, landing, appending and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope import fixed_values as fv
from themescope.catalog import stand_ins as si
from themescope.catalog.registry import query, table, texts
from themescope.operators import embedding, joins
from themescope.operators.preparation import length_band, with_clean_text
from themescope.sources import readers, writers
from themescope.session import scratch_path
from themescope.streaming.incremental import run_available, stream_table


@query("raw_csv_scan", f"""WITH {si.RAW}
SELECT date_received, product, sub_product, md5(narrative) AS digest, length(narrative) AS chars, complaint_id, issue, sub_issue FROM raw""")
def raw_csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "raw-csv")
    writers.export_csv(si.raw_complaints(spark, folder), path)
    raw = readers.read_raw_csv(spark, path)
    text = F.col("Consumer complaint narrative")
    return raw.select(
        F.col("Date received").alias("date_received"), F.col("Product").alias("product"),
        F.col("Sub-product").alias("sub_product"), F.md5(text).alias("digest"), F.length(text).alias("chars"),
        F.col("Complaint ID").alias("complaint_id"), F.col("Issue").alias("issue"),
        F.col("Sub-issue").alias("sub_issue"),
    )


@query("missing_spellings", """SELECT CASE WHEN lang NOT IN ('es', 'de') THEN lang END AS product, source AS company, count(*) AS n
FROM documents GROUP BY ALL""")
def missing_spellings(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        F.when(F.col("lang") == "es", "NA").when(F.col("lang") == "de", "None").otherwise(F.col("lang")).alias("product"),
        F.col("source").alias("company"),
    )
    return readers.null_tokens(docs, ["product"]).groupBy("product", "company").agg(F.count(F.lit(1)).alias("n"))


@query("landed_months", f"""WITH {si.RAW}, d AS (SELECT *, {si._DATE} AS day FROM raw)
SELECT strftime(day, '%Y-%m') AS month, count(*) AS n, count(narrative) AS with_text FROM d
WHERE day >= DATE '{fv.MIN_DATE}' GROUP BY 1""")
def landed_months(spark: SparkSession, folder: str) -> DataFrame:
    landed = readers.land_raw(si.raw_complaints(spark, folder), scratch_path(spark, "landed"))
    recent = readers.since_partition(landed)
    return recent.groupBy("month").agg(
        F.count(F.lit(1)).alias("n"), F.count("Consumer complaint narrative").alias("with_text")
    )


@query("stage_ids", "SELECT doc_id FROM documents")
def stage_ids(spark: SparkSession, folder: str) -> DataFrame:
    return readers.read_ids(spark, f"{folder}/documents.parquet", "doc_id")


@query("stage_round_trip", f"WITH {si.TOPIC_ROWS} SELECT complaint_id, array_to_string(all_topics_discussed, '|') AS topics, cluster_id FROM topic_rows")
def stage_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    stored = writers.write_stage(si.topic_rows(spark, folder), scratch_path(spark, "stage"))
    return stored.select("complaint_id", F.array_join("all_topics_discussed", "|").alias("topics"), "cluster_id")


@query("csv_export", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def csv_export(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "export")
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    writers.export_csv(docs, path)
    read = readers.read_raw_csv(spark, path, docs.schema)
    return read.select("doc_id", "lang", F.md5("text").alias("digest"))


@query("append_and_resume", "SELECT doc_id, lang FROM documents")
def append_and_resume(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "append")
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    writers.append_missing(docs.filter("lang <> 'en'"), path, ["doc_id"])
    return writers.append_missing(docs, path, ["doc_id"])


@query("not_done_yet", """SELECT doc_id AS complaint_id, lang AS dataset_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND d.lang = 'en')""")
def not_done_yet(spark: SparkSession, folder: str) -> DataFrame:
    todo = table(spark, folder, "documents").select(F.col("doc_id").alias("complaint_id"), F.col("lang").alias("dataset_id"))
    done = table(spark, folder, "labels").select(F.col("doc_id").alias("complaint_id"), F.lit("en").alias("dataset_id"))
    return joins.not_done(todo, done)


@query("vector_cache_split", """SELECT count(*) FILTER (d.doc_id IN (SELECT doc_id FROM labels) AND d.lang <> 'fr') AS hits,
       count(*) FILTER (NOT (d.doc_id IN (SELECT doc_id FROM labels) AND d.lang <> 'fr')) AS misses FROM documents d""")
def vector_cache_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).select(F.col("doc_id").alias("complaint_id"), "lang", F.col("text").alias("narrative"))
    known = table(spark, folder, "labels").select(F.col("doc_id").alias("complaint_id"))
    # Stored before the French texts were edited, so their digests differ.
    older = docs.join(known, "complaint_id", "left_semi").withColumn(
        "narrative", F.when(F.col("lang") == "fr", F.concat("narrative", F.lit("!"))).otherwise(F.col("narrative"))
    )
    return embedding.cache_split(embedding.with_feature_key(docs, "m"), embedding.with_feature_key(older, "m"))


@query("missing_vectors", "SELECT doc_id AS complaint_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_vectors(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).select(F.col("doc_id").alias("complaint_id"), F.col("text").alias("narrative"))
    known = table(spark, folder, "labels").select(F.col("doc_id").alias("complaint_id"))
    keyed = embedding.with_feature_key(docs, "m")
    return embedding.missing_vectors(keyed, keyed.join(known, "complaint_id", "left_semi")).select("complaint_id")


@query("stored_vectors", "SELECT vec_id AS complaint_id, 'm' AS model, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "features")
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("complaint_id"), F.lit("m").alias("model"), F.lit("h").alias("text_hash"), "embedding"
    )
    writers.append_run(vectors, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return readers.read_features(spark, path).select("complaint_id", "model", F.round(total, 6).alias("total"))


@query("decoded_lists", f"WITH {si.TOPIC_ROWS} SELECT complaint_id, array_to_string(all_topics_discussed, '|') AS topics FROM topic_rows")
def decoded_lists(spark: SparkSession, folder: str) -> DataFrame:
    escaped = F.transform("all_topics_discussed", lambda t: F.regexp_replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), "'", r"\\'"))
    legacy = F.concat(F.lit("['"), F.array_join(escaped, "', '"), F.lit("']"))
    rows = si.topic_rows(spark, folder).select("complaint_id", legacy.alias("legacy"))
    return rows.select("complaint_id", F.array_join(readers.decode_list(F.col("legacy")), "|").alias("topics"))


@query("upload_ids", "SELECT page_id AS complaint_id, url FROM pages")
def upload_ids(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("url", F.col("html").alias("narrative"))
    return readers.read_upload(pages).select("complaint_id", "url")


@query("incremental_events", """SELECT event_id, user_id, event_type, round(value, 2) AS value FROM events""")
def incremental_events(spark: SparkSession, folder: str) -> DataFrame:
    sink, progress = scratch_path(spark, "events-out"), scratch_path(spark, "events-progress")
    schema = table(spark, folder, "events").schema
    for _ in range(2):  # the second run finds nothing new
        events = stream_table(spark, folder, schema, pattern="events.parquet")
        run_available(
            events, lambda e: e.select("event_id", "user_id", "event_type", F.round("value", 2).alias("value")),
            sink, progress,
        )
    return spark.read.parquet(sink)


@query("incremental_cleaning", rf"""WITH c AS (SELECT doc_id, {si.sql_clean(si._sql_masks('text'))} AS narrative FROM documents)
SELECT doc_id, md5(narrative) AS digest, {si.sql_words('narrative')} AS word_count FROM c
WHERE {si.sql_words('narrative')} BETWEEN {fv.MIN_WORDS} AND {fv.MAX_WORDS}""")
def incremental_cleaning(spark: SparkSession, folder: str) -> DataFrame:
    sink, progress = scratch_path(spark, "clean-out"), scratch_path(spark, "clean-progress")
    schema = table(spark, folder, "documents").schema
    docs = stream_table(spark, folder, schema, pattern="documents.parquet").select(
        "doc_id", si.masked_text(F.col("text")).alias("narrative")
    )
    run_available(docs, lambda d: length_band(with_clean_text(d)), sink, progress)
    return spark.read.parquet(sink).select("doc_id", F.md5("narrative").alias("digest"), "word_count")
