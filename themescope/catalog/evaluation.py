"""Joins with the truth, and agreement scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope import fixed_values as fv
from themescope.catalog import stand_ins as si
from themescope.catalog.registry import query, table
from themescope.operators import aggregates as agg, contingency as ct, joins
from themescope.operators.k_selection import choose_k, elbow
from themescope.plans.evaluate import Evaluation, evaluate_cells, evaluate_clusters, sweep_from_store
from themescope.session import scratch_path
from themescope.sources.writers import write_bucketed

_JUDGED_CELLS = f"""{si.JUDGED}, cells AS (
  SELECT truth, cluster_id AS cluster, count(*) AS n FROM judged
  WHERE truth IS NOT NULL AND cluster_id IS NOT NULL GROUP BY 1, 2)"""
_DOC_CELLS = f"""{si.DOCUMENT_CELLS}, cells AS (
  SELECT truth, cluster_id AS cluster, count(*) AS n FROM document_cells GROUP BY 1, 2)"""
_SUPPORTED = f"""scored AS (SELECT truth, cluster, n FROM (
  SELECT *, sum(n) OVER (PARTITION BY truth) AS support FROM cells) WHERE support >= {fv.MIN_CATEGORY_SUPPORT})"""


def _agreement(cells: str) -> str:
    """CTE ``agreement`` by the textbook formulas, from marginal tables."""
    return f"""a AS (SELECT truth, sum(n)::DOUBLE AS a FROM {cells} GROUP BY 1),
b AS (SELECT cluster, sum(n)::DOUBLE AS b FROM {cells} GROUP BY 1),
t AS (SELECT sum(n)::DOUBLE AS total FROM {cells}),
pairs AS (SELECT (SELECT sum(n::DOUBLE * (n - 1) / 2) FROM {cells}) AS pboth,
                 (SELECT sum(a * (a - 1) / 2) FROM a) AS pa, (SELECT sum(b * (b - 1) / 2) FROM b) AS pb,
                 (SELECT total * (total - 1) / 2 FROM t) AS all_pairs),
info AS (SELECT (SELECT -sum(a / total * ln(a / total)) FROM a, t) AS ha,
                (SELECT -sum(b / total * ln(b / total)) FROM b, t) AS hb,
                (SELECT sum(n / total * ln(n * total / (a * b))) FROM {cells} JOIN a USING (truth) JOIN b USING (cluster), t) AS mi),
agreement AS (SELECT CAST((SELECT total FROM t) AS BIGINT) AS rows, (SELECT count(*) FROM a) AS categories,
       (SELECT count(*) FROM b) AS clusters,
       CASE WHEN pa = pboth AND pb = pboth THEN 1.0 ELSE (pboth - pa * pb / all_pairs) / ((pa + pb) / 2 - pa * pb / all_pairs) END AS ari,
       CASE WHEN (SELECT count(*) FROM a) = 1 AND (SELECT count(*) FROM b) = 1 THEN 1.0
            WHEN mi <= 1e-12 THEN 0.0 ELSE mi / ((ha + hb) / 2) END AS nmi FROM pairs, info)"""


def _profile(cells: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, truth) AS rn,
         sum(n) OVER (PARTITION BY cluster) AS size, count(*) OVER (PARTITION BY cluster) AS kinds FROM {cells}),
profile AS (SELECT cluster, CAST(size AS BIGINT) AS size, kinds AS distinct_true_categories,
                   round_even(n / size * 1000, 0) / 1000 AS purity, truth AS dominant_category FROM ranked WHERE rn = 1)"""


def _judged_cells(spark: SparkSession, folder: str) -> DataFrame:
    return ct.contingency(si.judged(spark, folder), "truth", "cluster_id")


def _document_cells(spark: SparkSession, folder: str) -> DataFrame:
    return ct.contingency(si.document_cells(spark, folder), "truth", "cluster_id")


def _scores(df: DataFrame) -> DataFrame:
    return df.withColumns({"ari": F.round("ari", 6), "nmi": F.round("nmi", 6)})


@query("contingency_table", f"WITH {_JUDGED_CELLS} SELECT * FROM cells")
def contingency_table(spark: SparkSession, folder: str) -> DataFrame:
    return _judged_cells(spark, folder)


@query("supported_rows", f"""WITH {si.DOCUMENT_CELLS}
SELECT complaint_id, truth FROM document_cells WHERE truth IN (
  SELECT truth FROM document_cells GROUP BY 1 HAVING count(*) >= {fv.MIN_CATEGORY_SUPPORT})""")
def supported_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ct.supported_rows(si.document_cells(spark, folder), "truth").select("complaint_id", "truth")


@query("agreement_scores", f"""WITH {_DOC_CELLS}, {_SUPPORTED}, {_agreement('scored')}
SELECT rows, categories, clusters, round(ari, 6) AS ari, round(nmi, 6) AS nmi FROM agreement""")
def agreement_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(ct.agreement(ct.supported(_document_cells(spark, folder))))


@query("agreement_of_themes", f"""WITH {_JUDGED_CELLS}, {_agreement('cells')}
SELECT rows, categories, clusters, round(ari, 6) AS ari, round(nmi, 6) AS nmi FROM agreement""")
def agreement_of_themes(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(ct.agreement(_judged_cells(spark, folder)))


@query("cluster_profile", f"""WITH {_DOC_CELLS}, {_profile('cells')}
SELECT *, purity AS dominant_category_share FROM profile""")
def cluster_profile(spark: SparkSession, folder: str) -> DataFrame:
    return ct.worst_first(ct.cluster_profile(_document_cells(spark, folder)))


@query("mean_purity", f"""WITH {_DOC_CELLS}, {_profile('cells')}
SELECT round(avg(purity), 6) AS mean_purity, round(sum(purity * size) / sum(size), 6) AS weighted_purity,
       count(*) AS clusters FROM profile""")
def mean_purity(spark: SparkSession, folder: str) -> DataFrame:
    scores = ct.mean_purity(ct.cluster_profile(_document_cells(spark, folder)))
    return scores.withColumns({c: F.round(c, 6) for c in ("mean_purity", "weighted_purity")})


@query("junk_drawers", f"""WITH {_JUDGED_CELLS}, {_profile('cells')}
SELECT *, purity AS dominant_category_share FROM profile
WHERE distinct_true_categories >= (
  SELECT greatest({fv.JUNK_MIN_CATEGORIES}, round_even(2.0 * count(DISTINCT truth) / count(DISTINCT cluster), 0)) FROM cells)
  AND purity < {fv.JUNK_MAX_PURITY}""")
def junk_drawers(spark: SparkSession, folder: str) -> DataFrame:
    return ct.junk_drawers(ct.stored_contingency(si.judged(spark, folder), "truth", "cluster_id"))


_COVERAGE = f"""sizes AS (SELECT truth, sum(n) AS n FROM cells GROUP BY 1), coverage AS (
  SELECT count(*) AS n_categories_total, count(*) FILTER (n >= {fv.MIN_CATEGORY_SUPPORT}) AS n_categories_scored,
         count(*) FILTER (n < {fv.MIN_CATEGORY_SUPPORT}) AS n_categories_excluded, CAST(sum(n) AS BIGINT) AS n_rows_total,
         CAST(coalesce(sum(n) FILTER (n >= {fv.MIN_CATEGORY_SUPPORT}), 0) AS BIGINT) AS n_rows_scored,
         CAST(coalesce(sum(n) FILTER (n < {fv.MIN_CATEGORY_SUPPORT}), 0) AS BIGINT) AS n_rows_excluded FROM sizes)"""


@query("truth_coverage", f"""WITH {_DOC_CELLS}, {_COVERAGE}
SELECT *, n_rows_scored >= {fv.RELIABLE_ROWS} AS reliable FROM coverage""")
def truth_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return ct.coverage(_document_cells(spark, folder))


@query("evaluation_summary", f"""WITH {_DOC_CELLS}, {_COVERAGE}, {_SUPPORTED}, {_agreement('scored')}, {_profile('scored')}
SELECT coverage.*, n_rows_scored >= {fv.RELIABLE_ROWS} AS reliable, clusters,
       round(ari, 4) AS ari, round(nmi, 4) AS nmi,
       (SELECT round(avg(purity), 4) FROM profile) AS mean_purity,
       (SELECT round(sum(purity * size) / sum(size), 4) FROM profile) AS weighted_purity
FROM coverage, agreement""")
def evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    cells = ct.stored_contingency(si.document_cells(spark, folder), "truth", "cluster_id")
    return evaluate_cells(cells).summary


# Documents clustered by source, against what is known about them in another table.
_LABEL_CELLS = """cells AS (SELECT 'q' || quality || 't' || toxic AS truth, source AS cluster, count(*) AS n
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2)"""


def _labelled_tables(spark: SparkSession, folder: str) -> Evaluation:
    """Both tables stored in buckets of the id, so their join moves nothing."""
    clusters = table(spark, folder, "documents").select(F.col("doc_id").alias("complaint_id"), F.col("source").alias("cluster_id"))
    truth = table(spark, folder, "labels").select(
        F.col("doc_id").alias("complaint_id"),
        F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("Issue"))
    stored = [write_bucketed(t, scratch_path(spark, "bucketed"), "complaint_id", 8) for t in (clusters, truth)]
    return evaluate_clusters(*stored)


@query("evaluation_of_tables", f"""WITH {_LABEL_CELLS}, {_COVERAGE}, {_SUPPORTED}, {_agreement('scored')}, {_profile('scored')}
SELECT coverage.*, n_rows_scored >= {fv.RELIABLE_ROWS} AS reliable, clusters,
       round(ari, 4) AS ari, round(nmi, 4) AS nmi,
       (SELECT round(avg(purity), 4) FROM profile) AS mean_purity,
       (SELECT round(sum(purity * size) / sum(size), 4) FROM profile) AS weighted_purity
FROM coverage, agreement""")
def evaluation_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled_tables(spark, folder).summary


@query("breakdown_of_tables", f"""WITH {_LABEL_CELLS}, {_SUPPORTED}, {_profile('scored')}
SELECT *, purity AS dominant_category_share FROM profile""")
def breakdown_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled_tables(spark, folder).breakdown


@query("junk_of_tables", f"""WITH {_LABEL_CELLS}, {_SUPPORTED}, {_profile('scored')}
SELECT *, purity AS dominant_category_share FROM profile
WHERE distinct_true_categories >= (
  SELECT greatest({fv.JUNK_MIN_CATEGORIES}, round_even(2.0 * count(DISTINCT truth) / count(DISTINCT cluster), 0)) FROM scored)
  AND purity < {fv.JUNK_MAX_PURITY}""")
def junk_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled_tables(spark, folder).junk


@query("sweep_from_store", f"""WITH sizes AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1)
SELECT k, CAST(coalesce(sum(n) FILTER (n >= {fv.MIN_CATEGORY_SUPPORT}), 0) AS BIGINT) AS n_rows_scored,
       CAST(coalesce(sum(n) FILTER (n < {fv.MIN_CATEGORY_SUPPORT}), 0) AS BIGINT) AS n_rows_excluded,
       count(*) FILTER (n >= {fv.MIN_CATEGORY_SUPPORT}) AS n_categories_scored, true AS sane
FROM sizes, (SELECT unnest([6, 10])::INTEGER AS k) GROUP BY k""")
def sweep_of_stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "complaint_id")
    features = vectors.select("complaint_id", F.lit("m").alias("model"), F.lit("h").alias("text_hash"), "embedding")
    truth = vectors.select("complaint_id", F.col("label").cast("string").alias("product"))
    scores, coverage = sweep_from_store(features, truth, [6, 10], "product", "m", starts=2, max_iter=10)
    sane = F.col("ari").between(-1, 1) & F.col("nmi").between(0, 1) & F.col("silhouette").between(-1, 1) & (F.col("inertia") > 0)
    found = coverage.select("n_rows_scored", "n_rows_excluded", "n_categories_scored").first().asDict()
    return scores.select("k", sane.alias("sane"), *[F.lit(v).alias(c) for c, v in found.items()])


@query("truth_join", """SELECT d.doc_id AS complaint_id, d.source AS cluster_id, l.quality AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def truth_join(spark: SparkSession, folder: str) -> DataFrame:
    predicted = table(spark, folder, "documents").select(
        F.col("doc_id").alias("complaint_id"), F.col("source").alias("cluster_id"), F.lit(0).alias("label")
    )
    truth = table(spark, folder, "labels").select(F.col("doc_id").alias("complaint_id"), F.col("quality").alias("label"))
    return joins.with_truth(predicted, truth, "label")


@query("last_truth", """SELECT c_custkey AS complaint_id, t.label FROM customer LEFT JOIN (
  SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS label FROM orders GROUP BY 1) t ON c_custkey = o_custkey""")
def last_truth(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "customer").select(F.col("c_custkey").alias("complaint_id"))
    truth = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("complaint_id"), "o_orderkey", F.col("o_orderpriority").alias("label")
    )
    return joins.last_truth(ids, truth, "label", "o_orderkey")


@query("source_match", f"""WITH p AS (SELECT DISTINCT doc_id FROM documents), k AS (SELECT DISTINCT doc_id FROM labels),
c AS (SELECT count(*) AS predicted_ids, count(k.doc_id) AS matched_ids FROM p LEFT JOIN k USING (doc_id))
SELECT *, round(coalesce(matched_ids / nullif(predicted_ids, 0), 0), 6) AS match_share,
       coalesce(matched_ids / nullif(predicted_ids, 0), 0) > {fv.MATCH_SHARE} AS matches FROM c""")
def source_match(spark: SparkSession, folder: str) -> DataFrame:
    found = joins.truth_match(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")
    return found.withColumn("match_share", F.round("match_share", 6))


@query("common_ids", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def common_ids(spark: SparkSession, folder: str) -> DataFrame:
    return joins.common_ids(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


@query("row_difference", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def row_difference(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id").exceptAll(table(spark, folder, "labels").select("doc_id"))


# A table shaped like a k sweep: one row per line number of the order lines.
_SWEEP = """sweep AS (SELECT l_linenumber AS k, round(avg(l_tax), 6) AS silhouette, round(avg(l_discount), 6) AS ari,
  round(avg(l_quantity) / 100, 6) AS nmi, round(sum(l_extendedprice) / l_linenumber, 2) AS inertia FROM lineitem GROUP BY 1)"""
_DISTANCE = """scaled AS (SELECT *, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ())::DOUBLE AS x,
  (inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ()) AS y FROM sweep),
ends AS (SELECT arg_min(y, k) AS start, arg_max(y, k) - arg_min(y, k) AS climb FROM scaled),
curve AS (SELECT k, silhouette, ari, nmi, inertia, abs(y - start - climb * x) / sqrt(1 + climb * climb) AS distance
  FROM scaled, ends)"""


def _sweep(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(
        F.round(F.avg("l_tax"), 6).alias("silhouette"), F.round(F.avg("l_discount"), 6).alias("ari"),
        F.round(F.avg("l_quantity") / 100, 6).alias("nmi"),
        F.round(F.sum("l_extendedprice") / F.first("l_linenumber"), 2).alias("inertia"),
    )


@query("elbow_distances", f"""WITH {_SWEEP}, {_DISTANCE}
SELECT k, silhouette, ari, nmi, inertia, round(distance, 6) AS distance FROM curve""")
def elbow_distances(spark: SparkSession, folder: str) -> DataFrame:
    return elbow(_sweep(spark, folder)).withColumn("distance", F.round("distance", 6))


@query("chosen_k", f"""WITH {_SWEEP}, {_DISTANCE},
a AS (SELECT * FROM curve ORDER BY ari DESC, k LIMIT 1), s AS (SELECT * FROM curve ORDER BY silhouette DESC, k LIMIT 1),
e AS (SELECT * FROM curve ORDER BY distance DESC, k LIMIT 1)
SELECT a.k AS k_ari, a.ari AS best_ari, a.silhouette AS silhouette_at_k_ari, s.k AS k_silhouette,
       s.silhouette AS best_silhouette, s.ari AS ari_at_k_silhouette, e.k AS k_elbow, e.ari AS ari_at_k_elbow,
       a.k <> s.k AS disagree FROM a, s, e""")
def chosen_k(spark: SparkSession, folder: str) -> DataFrame:
    return choose_k(_sweep(spark, folder))


@query("cluster_sizes", f"WITH {si.DOCUMENT_CELLS} SELECT cluster_id, count(*) AS n FROM document_cells GROUP BY 1")
def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return agg.frequency(si.document_cells(spark, folder), "cluster_id")
