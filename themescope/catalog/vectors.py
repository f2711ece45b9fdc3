"""Unit vectors, clusters and their geometry."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope.catalog.registry import query, table, texts
from themescope.functions.vectors import normalise_vectors, with_unit_features
from themescope.operators import clustering as cl
from themescope.operators.embedding import hashed_tfidf
from themescope.operators.k_selection import sweep_k
from themescope.operators.stable_clusters import stable_kmeans

_DIM = "list_transform(embedding, lambda x: x::DOUBLE)"
_UNIT = f"""u AS (SELECT vec_id, label, {_DIM} AS v, sqrt(list_dot_product({_DIM}, {_DIM})) AS norm FROM embeddings),
unit AS (SELECT vec_id, label, list_transform(v, lambda x: x / CASE WHEN norm = 0 THEN 1 ELSE norm END) AS v FROM u)"""
_SILHOUETTE = f"""{_UNIT},
d AS (SELECT a.vec_id, a.label, b.label AS other, sum(1 - list_dot_product(a.v, b.v)) AS s, count(*) AS n
      FROM unit a JOIN unit b ON a.vec_id <> b.vec_id GROUP BY ALL),
ab AS (SELECT vec_id, label, max(s / n) FILTER (label = other) AS inner_d, min(s / n) FILTER (label <> other) AS near_d FROM d GROUP BY ALL),
points AS (SELECT vec_id, label, CASE WHEN inner_d IS NULL OR near_d IS NULL OR greatest(inner_d, near_d) = 0 THEN 0
      ELSE (near_d - inner_d) / greatest(inner_d, near_d) END AS silhouette FROM ab)"""
_CENTRES = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS c FROM e GROUP BY 1, 2)"""


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def _unit(spark: SparkSession, folder: str) -> DataFrame:
    return with_unit_features(_embeddings(spark, folder)).select("vec_id", "label", "features")


@query("unit_vectors", f"""WITH {_UNIT}, x AS (SELECT vec_id, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS pos FROM unit)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(value, 6) AS value FROM x""")
def unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    unit = normalise_vectors(_embeddings(spark, folder))
    return unit.select("vec_id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 6) + 0.0)


@query("nearest_centres", f"""WITH {_CENTRES},
d AS (SELECT vec_id, m.label AS cluster_id, sum((x - c) * (x - c)) AS square_distance FROM e JOIN m USING (i) GROUP BY 1, 2)
SELECT vec_id, CAST(arg_min(cluster_id, (square_distance, cluster_id)) AS BIGINT) AS cluster_id,
       round(min(square_distance), 6) AS square_distance FROM d GROUP BY 1""")
def nearest_centres(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _embeddings(spark, folder)
    mean = Summarizer.mean(array_to_vector(F.col("embedding")))
    centres = vectors.groupBy(F.col("label").cast("bigint").alias("centroid_id")).agg(
        vector_to_array(mean).alias("embedding")
    )
    return cl.assign_to_centroids(vectors, centres).select(
        "vec_id", "cluster_id", F.round("square_distance", 6).alias("square_distance")
    )


@query("inertia_by_label", f"""WITH {_UNIT}, e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i, vec_id FROM unit),
m AS (SELECT label, i, avg(x) AS c FROM e GROUP BY 1, 2)
SELECT label, count(DISTINCT vec_id) AS n, round(sum((x - c) * (x - c)), 6) AS inertia FROM e JOIN m USING (label, i) GROUP BY 1""")
def inertia_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return cl.inertia(_unit(spark, folder), "label").withColumn("inertia", F.round("inertia", 6))


@query("point_silhouettes", f"WITH {_SILHOUETTE} SELECT vec_id, label, round(silhouette, 6) AS silhouette FROM points")
def point_silhouettes(spark: SparkSession, folder: str) -> DataFrame:
    return cl.point_silhouettes(_unit(spark, folder), "label").select(
        "vec_id", "label", (F.round("silhouette", 6) + 0.0).alias("silhouette")
    )


@query("silhouette_report", f"""WITH {_SILHOUETTE} SELECT label, count(*) AS n, round(avg(silhouette), 6) AS mean_silhouette,
  count(*) FILTER (silhouette < 0) AS negative FROM points GROUP BY 1""")
def silhouette_report(spark: SparkSession, folder: str) -> DataFrame:
    report = cl.silhouette_report(cl.point_silhouettes(_unit(spark, folder), "label"), "label")
    return report.withColumn("mean_silhouette", F.round("mean_silhouette", 6))


@query("silhouette_order", f"""WITH {_SILHOUETTE}, r AS (SELECT vec_id, label, round(silhouette, 6) AS silhouette FROM points),
sizes AS (SELECT label, count(*) + 10 AS h FROM r GROUP BY 1),
base AS (SELECT label, 10 + coalesce(sum(h) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sizes)
SELECT vec_id, label, silhouette,
       CAST(b + row_number() OVER (PARTITION BY label ORDER BY silhouette, vec_id) - 1 AS BIGINT) AS position FROM r JOIN base USING (label)""")
def silhouette_order(spark: SparkSession, folder: str) -> DataFrame:
    scored = point_silhouettes(spark, folder)
    return cl.silhouette_order(scored, "label", "vec_id")


@query("mean_silhouette", f"WITH {_SILHOUETTE} SELECT round(avg(silhouette), 6) AS silhouette FROM points")
def mean_silhouette(spark: SparkSession, folder: str) -> DataFrame:
    score = cl.mean_silhouette(_unit(spark, folder), "label")
    return spark.createDataFrame([(score,)], "silhouette double").select(F.round("silhouette", 6).alias("silhouette"))


@query("kmeans_clusters")
def kmeans_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cl.kmeans_labels(_unit(spark, folder), 12, max_iter=20).select("vec_id", "cluster_id")


@query("stable_clusters", "SELECT vec_id, true AS in_range, true AS cost_is_inertia, true AS cheaper_than_one FROM embeddings")
def stable_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Ids, range and cost of k-means: the cost is the inertia of the labels, and below that of one cluster."""
    unit = _unit(spark, folder)
    labels, cost = stable_kmeans(unit, "vec_id", 12, starts=4, max_iter=20)
    labelled = unit.drop("label").join(labels, "vec_id")
    inertia = cl.inertia(labelled, "cluster_id").agg(F.sum("inertia")).first()[0]
    whole = cl.inertia(unit.withColumn("one", F.lit(0)), "one").first().inertia
    return labels.select(
        "vec_id", F.col("cluster_id").between(0, 11).alias("in_range"),
        F.lit(abs(inertia - cost) < 1e-3 * whole).alias("cost_is_inertia"), F.lit(cost < whole).alias("cheaper_than_one"))


@query("hashed_vector_norms", "SELECT doc_id, CAST(256 AS INTEGER) AS dimensions, CASE WHEN regexp_matches(text, '[A-Za-z0-9_]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents")
def hashed_vector_norms(spark: SparkSession, folder: str) -> DataFrame:
    vectors = hashed_tfidf(texts(spark, folder), "text")
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return vectors.select("doc_id", F.size("embedding").alias("dimensions"), F.round(F.sqrt(squares), 4).alias("norm"))


@query("k_sweep")
def k_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return sweep_k(_embeddings(spark, folder), "label", [6, 10, 14], starts=2, max_iter=20)


@query("hashed_vectors")
def hashed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return hashed_tfidf(texts(spark, folder), "text").select("doc_id", "embedding")
