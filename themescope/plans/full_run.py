"""Extract, cluster, label and report, with a ledger of what each step really did."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope import fixed_values as fv
from themescope.functions.vectors import with_unit_features
from themescope.operators import aggregates as agg, clustering, embedding, naming
from themescope.operators.extraction import Hook
from themescope.operators.guards import need_more_rows_than
from themescope.operators.ordering import first_rows
from themescope.operators.preparation import require_columns
from themescope.plans import label_runs, model_runs, phrase_state
from themescope.plans.insights import generate_insights
from themescope.sources.readers import read_features, try_read
from themescope.sources.writers import append_run, write_stage

@dataclass(frozen=True)
class RunOptions:
    """Where tables go, how much to process, and the caller's models (None: the defaults)."""

    folder: str
    dataset_id: str = "default"
    limit: int | None = None
    resume: bool = True
    n_clusters: int = fv.N_CLUSTERS
    kmeans_starts: int = fv.KMEANS_STARTS
    max_iter: int = 100
    top_n: int = fv.TOP_THEMES
    seed: int = fv.SEED
    embed_model: str = "hashed-tfidf"
    embed_dimensions: int = 256
    # A model's answers are committed in batches of commit_chunks chunks of commit_rows rows.
    commit_rows: int = fv.CHECKPOINT_ROWS
    commit_chunks: int = 1
    extract_hook: Hook | None = None
    embed_hook: Hook | None = None
    label_hook: Hook | None = None
    # Models asked for cluster names, in order; the hook is told which one is meant.
    label_models: tuple[str, ...] = ("default",)


@dataclass
class RunResult:
    output: DataFrame
    reports: dict[str, DataFrame]
    ledger: list[dict] = field(default_factory=list)


def extract_topics(rows: DataFrame, options: RunOptions) -> tuple[DataFrame, dict]:
    """Step 1: topics and sentiment for every row that has none yet.

    With a model, its answers are committed batch by batch; a call that died is continued by the next one.
    The default extractor ends with the same topics however the rows arrived.
    """
    chosen = first_rows(rows, ["complaint_id"], options.limit).withColumn(
        "dataset_id", F.lit(options.dataset_id)
    )
    if options.extract_hook:
        written, done, before = model_runs.extract_with_hook(
            chosen, options.folder, options.extract_hook, options.resume, options.commit_rows, options.commit_chunks)
        new, tried = done.newly_processed, done.attempted
        more = {"prompt_tokens": done.prompt_tokens, "completion_tokens": done.completion_tokens,
                "failure_samples": list(done.failure_samples)}
    else:
        written, done = phrase_state.extract_default(chosen, options.folder, options.dataset_id, options.resume)
        before, tried = done["resumed_from"], done["new"]
        more = {"prompt_tokens": 0, "completion_tokens": 0, "failure_samples": [],
                "ranked_again": done["ranked_again"]}
        # Later steps read the topics several times.
        written = write_stage(written, f"{options.folder}/topics_default")
    topics = written.filter(F.col("dataset_id") == options.dataset_id)
    # One row per model that served: a scan of two narrow columns.
    served = topics.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("all_topics_discussed")).alias("topics")).collect()
    rows_out = sum(r.n for r in served)
    if not options.extract_hook:
        new = rows_out - before
    return topics, {
        "step": "extract_topics", "rows_in": chosen.count(), "rows_out": rows_out,
        "resumed_from": before, "newly_processed": new, "failed": tried - new,
        "total_topics": sum(r.topics for r in served), **more,
        "model_usage": {r.model_version: r.n for r in sorted(served, key=lambda r: (-r.n, r.model_version))},
    }


def store_vectors(topics: DataFrame, options: RunOptions) -> DataFrame:
    """Vectors of all rows; only texts without a stored vector are embedded."""
    spark, path = topics.sparkSession, f"{options.folder}/features"
    keyed = embedding.with_feature_key(topics, options.embed_model)
    if options.embed_hook:
        stored = try_read(spark, path)
        missing = keyed if stored is None else embedding.missing_vectors(keyed, stored)
        append_run(embedding.embed_with(missing, options.embed_hook), path)
    else:
        # The default weights depend on all texts, so its vectors are always made together.
        vectors = embedding.hashed_tfidf(keyed, "narrative", options.embed_dimensions)
        write_stage(vectors.select(*embedding.FEATURE_KEY, "embedding"), path)
    features = read_features(spark, path)
    wanted = keyed.select(*embedding.FEATURE_KEY)
    return wanted.join(features, embedding.FEATURE_KEY).select("complaint_id", "embedding")


def cluster_rows(topics: DataFrame, options: RunOptions) -> tuple[DataFrame, dict]:
    """Step 2: one cluster per complaint from its vector."""
    k = options.n_clusters
    unit = with_unit_features(store_vectors(topics, options)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = unit.count()
        need_more_rows_than(rows, k)
        model = clustering.best_kmeans(
            unit, k, starts=options.kmeans_starts, seed=options.seed, max_iter=options.max_iter
        )
        labels = model.transform(unit)
        silhouette = clustering.mean_silhouette(labels)
        clustered = write_stage(
            topics.join(labels.select("complaint_id", "cluster_id"), "complaint_id"),
            f"{options.folder}/clusters",
        )
    finally:
        unit.unpersist()
    share = agg.largest_share(clustered, "cluster_id").first()
    return clustered, {
        "step": "cluster_topics", "complaints": rows, "clusters": k,
        "unique_topics": agg.vocabulary(topics).count(), "silhouette_cosine": round(silhouette, 4),
        "largest_cluster_share": share.largest_share, "embedding_model": options.embed_model,
    }


def label_clusters(clustered: DataFrame, options: RunOptions) -> tuple[DataFrame, dict]:
    """Step 3: a theme name per cluster, put on its rows."""
    if options.label_hook:
        labels = label_runs.label_with_hook(
            naming.topic_samples(clustered), options.label_hook, f"{options.folder}/labels", options.label_models)
    else:
        labels = naming.distinctive_labels(clustered)
    output = write_stage(naming.label_rows(clustered, labels), f"{options.folder}/output")
    themes = output.agg(
        F.countDistinct("cluster_id").alias("clusters"), F.count(F.lit(1)).alias("rows"),
        F.countDistinct(F.when(
            F.col("general_topic_l1") == naming.or_fallback(F.lit(None).cast("string"), F.col("cluster_id")),
            F.col("cluster_id"),
        )).alias("fallbacks"),
    ).first()
    failed = [] if not options.label_hook else (
        labels.filter("label IS NULL").select("cluster_id", "error").orderBy("cluster_id").limit(fv.ERROR_SAMPLES).collect())
    share = agg.largest_share(output, "general_topic_l1").first()
    return output, {
        "step": "label_clusters", "clusters_labelled": themes.clusters, "output_rows": themes.rows,
        "clusters_using_fallback_name": themes.fallbacks, "largest_theme_share": share.largest_share,
        "failure_samples": [f"{r.cluster_id}: {r.error}"[: fv.MAX_ERROR_CHARS] for r in failed],
    }


def run_all(rows: DataFrame, options: RunOptions) -> RunResult:
    """All four steps over an input table; every step starts from the stored rows of the last."""
    require_columns(rows, ["complaint_id", "narrative", "product", "date"])
    topics, extracted = extract_topics(rows, options)
    clustered, grouped = cluster_rows(topics, options)
    output, named = label_clusters(clustered, options)
    reports = generate_insights(output, options.top_n)
    counts = reports["counts"].first().asDict()
    return RunResult(output, reports, [extracted, grouped, named, {"step": "generate_insights", **counts}])


def ledger_table(spark: SparkSession, ledger: list[dict]) -> DataFrame:
    """The ledger as rows of step, measure and value."""
    rows = [(entry["step"], name, str(value)) for entry in ledger for name, value in entry.items() if name != "step"]
    return spark.createDataFrame(rows, "step string, measure string, value string")
