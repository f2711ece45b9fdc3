"""Score a clustering against held-out categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from themescope import fixed_values as fv
from themescope.functions.numbers import round_even
from themescope.operators import contingency as ct
from themescope.operators.guards import need_rows
from themescope.operators.joins import unique_truth, with_truth
from themescope.operators.k_selection import sweep_k

# Names of the two truths to score against, and the columns that carry them.
TRUTH_LABELS = {"issue": "Issue", "product": "product"}


@dataclass(frozen=True)
class Evaluation:
    summary: DataFrame
    breakdown: DataFrame
    junk: DataFrame


def evaluate_cells(cells: DataFrame, minimum: int = fv.MIN_CATEGORY_SUPPORT) -> Evaluation:
    """All scores from the (stored) contingency table of the joined rows."""
    scored = ct.supported(cells, minimum)
    profile = ct.cluster_profile(scored)
    one = F.lit(1).alias("_one")
    summary = (
        ct.coverage(cells, minimum).select("*", one)
        .join(ct.agreement(scored).select("clusters", "ari", "nmi", one), "_one")
        .join(ct.mean_purity(profile).select("mean_purity", "weighted_purity", one), "_one")
        .drop("_one")
    )
    rounded = {c: round_even(F.col(c), 4) for c in ("ari", "nmi", "mean_purity", "weighted_purity")}
    return Evaluation(summary.withColumns(rounded), ct.worst_first(profile), ct.junk_drawers(scored))


def evaluate_clusters(
    clusters: DataFrame, truth: DataFrame, label: str = "issue", cluster: str = "cluster_id",
    key: str = "complaint_id", minimum: int = fv.MIN_CATEGORY_SUPPORT,
) -> Evaluation:
    """Join predictions with truth and score them; no matching id at all is an error.

    ``label`` is a column of ``truth``, or one of the names in ``TRUTH_LABELS``.

    The contingency table is stored once, so rows are joined once for all three results.
    """
    label = TRUTH_LABELS.get(label, label)
    merged = with_truth(clusters.select(key, cluster), truth, label, key)
    cells = ct.stored_contingency(merged, label, cluster)
    need_rows(cells, "no complaint id occurs in both the clusters and the truth")
    return evaluate_cells(cells, minimum)


def sweep_from_store(
    features: DataFrame, truth: DataFrame, ks: list[int], label: str = "issue", model: str | None = None,
    key: str = "complaint_id", order: str | None = None, minimum: int = fv.MIN_CATEGORY_SUPPORT, **options: int,
) -> tuple[DataFrame, DataFrame]:
    """The sweep over k on stored vectors against a truth table, and what of the truth was scored.

    ``features`` are stored vectors (of one ``model``, if several are stored); each looks its label up in
    ``truth``, where the last row of an id by ``order`` counts, or ids are unique.  Vectors without a label are
    clustered and not scored.
    """
    label = TRUTH_LABELS.get(label, label)
    wanted = features if model is None else features.filter(F.col("model") == model)
    vectors = need_rows(wanted.select(key, "embedding"), "no stored vectors: embed the texts first")
    columns = [key, label] if order is None else [key, order, label]
    known = vectors.join(unique_truth(truth.select(*columns), key, order), key, "left").select("embedding", label)
    table = sweep_k(known, label, ks, minimum, **options)
    sizes = known.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    return table, ct.coverage(sizes.withColumn("cluster", F.lit(0)), minimum)
