"""Registered queries of the operators here, each over its whole table, and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from themescope.llm import (
    alignment, bpe, decontaminate, exact_dedup, jaccard, license_scan, phrase_dedup, piece_bpe, pivot_clusters,
    quality, substring_dedup, toxicity, warc,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_warc_records")
def op1(spark, folder):
    return warc.round_trip(spark, table(spark, folder, "pages"))


@query("op2_substring_dedup")
def op2(spark, folder):
    return substring_dedup.report(substring_dedup.remove_repeats(table(spark, folder, "documents")))


@query("op3_license_scan")
def op3(spark, folder):
    return license_scan.license_scan(table(spark, folder, "documents"))


@query("op4_exact_dedup", """
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      regexp_replace(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]', '', 'g') AS content FROM documents),
    w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY content) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM w
""")
def op4(spark, folder):
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@query("op5_jaccard_join")
def op5(spark, folder):
    return jaccard.similar_groups(table(spark, folder, "documents"))


@query("op6_quality_classifier")
def op6(spark, folder):
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_toxicity")
def op8(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def vocabulary(name: str) -> str:
    """A public vocabulary file, which every executor has."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_bpe")
def op7(spark, folder):
    return bpe.encode_decode(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op9_decontaminate", rf"""
    WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
            FROM bw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM win),
    grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
              FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
    hits AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN win ON win.g = grams.g AND win.n = grams.n),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op9(spark, folder):
    return decontaminate.report(decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")))


@query("op10_phrase_dedup")
def op10(spark, folder):
    return phrase_dedup.report(phrase_dedup.remove_recurring(table(spark, folder, "documents")))


def _nearest_sql(name: str, centres: str) -> str:
    """Each vector with its nearest centroid under ``centres``."""
    gap = "list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"""{name} AS (SELECT vec_id, v, c, d FROM (
        SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, c) AS place
        FROM (SELECT q.row_id, q.vec_id, q.v, c.c, CAST({gap} AS BIGINT) AS d FROM q, {centres} c)) WHERE place = 1)"""


def _centres_sql(name: str, assigned: str, before: str) -> str:
    """floor(sum / count) by component; a centroid without vectors stays."""
    return f"""{name} AS (SELECT c, coalesce(n.v, b.v) AS v FROM {before} b LEFT JOIN (
        SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
        FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
              FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {assigned}) GROUP BY c, i)
        GROUP BY c) n USING (c))"""


@query("op11_pivot_clusters", f"""
    WITH q AS (SELECT row_number() OVER () AS row_id, vec_id,
                      list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
               FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), vec_id, v) - 1 AS c, v FROM q
           ORDER BY c LIMIT 16),
    {_nearest_sql("a1", "c0")}, {_centres_sql("c1", "a1", "c0")},
    {_nearest_sql("a2", "c1")}, {_centres_sql("c2", "a2", "c1")},
    {_nearest_sql("a3", "c2")}, {_centres_sql("c3", "a3", "c2")},
    {_nearest_sql("a4", "c3")}
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance,
           CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c3.v, ',')) AS centroid_sha256
    FROM a4 JOIN c3 USING (c)
""")
def op11(spark, folder):
    return pivot_clusters.pivot_clusters(table(spark, folder, "embeddings")).drop("exact_distances")


@query("op12_piece_bpe")
def op12(spark, folder):
    return piece_bpe.encode_decode(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op13_token_alignment")
def op13(spark, folder):
    return alignment.align(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"),
                           vocabulary("piece_bpe_32k.model"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
