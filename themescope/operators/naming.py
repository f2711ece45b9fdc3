"""Names for clusters: topic samples for a model, a default name, and labels on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from themescope import fixed_values as fv
from themescope.operators.small import small_side


def cluster_topics(
    df: DataFrame, cluster: str = "cluster_id", key: str = "complaint_id",
    topics: str = "all_topics_discussed",
) -> DataFrame:
    """Each cluster's distinct topics with their count and the place they were first seen.

    The place (row key, position) is packed into one wide decimal: unlike a struct it can be
    minimised in a hash aggregation, so the exploded rows are combined without being sorted.
    """
    phrases = df.select(cluster, key, F.posexplode_outer(topics).alias("pos", "topic")).filter(
        F.col("topic").isNotNull()
    )
    place = F.col(key).cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")
    return phrases.groupBy(cluster, "topic").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("seen"))


def topic_samples(
    df: DataFrame, cluster: str = "cluster_id", key: str = "complaint_id",
    topics: str = "all_topics_discussed", sample: int = fv.SAMPLE_TOPICS,
) -> DataFrame:
    """The first distinct topics of each cluster in the order they were first seen, joined.

    The rank filter reaches below the shuffle (each task keeps its own first few per cluster).
    """
    rank = F.row_number().over(W.partitionBy(cluster).orderBy("seen"))
    first = (
        cluster_topics(df, cluster, key, topics).withColumn("rank", rank)
        .filter(F.col("rank") <= sample)
    )
    listed = F.sort_array(F.collect_list(F.struct("rank", "topic")))
    return first.groupBy(cluster).agg(
        F.array_join(listed["topic"], fv.TOPIC_SEPARATOR).alias("sample_topics"),
        F.count(F.lit(1)).alias("sampled"),
    )


def distinctive_labels(
    df: DataFrame, cluster: str = "cluster_id", key: str = "complaint_id",
    topics: str = "all_topics_discussed",
) -> DataFrame:
    """Default name: the topic with the highest count x ln(1 + clusters / clusters with it)."""
    counts = cluster_topics(df, cluster, key, topics).select(cluster, "topic", "n")
    clusters = df.agg(F.countDistinct(cluster)).scalar()
    with_it = F.count(F.lit(1)).over(W.partitionBy("topic"))
    return (
        counts.withColumn("_clusters", with_it)
        .withColumn("_score", F.round(F.col("n") * F.ln(1.0 + clusters / F.col("_clusters")), 6))
        .groupBy(cluster)
        .agg(F.min_by("topic", F.struct(-F.col("_score"), "topic")).alias("label"),
             F.max("_score").alias("score"))
    )


def or_fallback(label: Column, cluster: Column) -> Column:
    return F.coalesce(label, F.concat(F.lit(fv.FALLBACK_LABEL), cluster.cast("string")))


def label_rows(
    df: DataFrame, labels: DataFrame, cluster: str = "cluster_id",
    topics: str = "all_topics_discussed",
) -> DataFrame:
    """Put each cluster's theme on its rows and add the topics as readable text."""
    names = small_side(labels.select(cluster, F.col("label").alias("_label")))
    return (
        df.join(names, cluster, "left")
        .withColumn("general_topic_l1", or_fallback(F.col("_label"), F.col(cluster)))
        .withColumn("topic_discussed", F.array_join(topics, fv.TOPIC_SEPARATOR))
        .drop("_label")
    )
