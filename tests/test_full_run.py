"""All steps together, with default models and with hooks."""

import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from themescope.operators import extraction as ex, naming
from themescope.schemas import INPUT, OUTPUT
from themescope.plans.full_run import RunOptions, ledger_table, run_all

# The hooks below run inside tasks, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def rows(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select(
        F.col("doc_id").alias("complaint_id"), F.col("text").alias("narrative"),
        F.col("source").alias("product"), F.lit("2024-02-03").alias("date"),
    )


def extract(batches):
    """Answers every text but the Spanish-looking ones; the first model is always over quota."""
    for batch in batches:
        out = []
        for row in batch.itertuples():
            raw = json.dumps({"topics": [row.narrative.split()[0], "shared topic"], "sentiment": "Negative"})
            good = row.complaint_id % 10 != 0
            out.append((row.dataset_id, row.complaint_id, "first", 0, 0, 429, "RateLimitError", None, 5, 0))
            out.append((row.dataset_id, row.complaint_id, "second", 1, 0, 200, None, raw if good else "{}", 5, 2))
        yield pd.DataFrame(out, columns=[
            "dataset_id", "complaint_id", "model", "model_rank", "attempt", "status", "error_type", "raw",
            "prompt_tokens", "completion_tokens",
        ])


def embed(batches):
    for batch in batches:
        vectors = [[float(len(t) % 7), float(t.count("e")), float(t.count("a") + 1)] for t in batch["narrative"]]
        yield batch.drop(columns="narrative").assign(embedding=vectors)


def label(batches):
    for batch in batches:
        raw = ['{"label": "Named"}' if c == 0 else "sorry" for c in batch["cluster_id"]]
        yield pd.DataFrame({"cluster_id": batch["cluster_id"], "raw": raw})


def test_hooks_and_resume(spark, rows, tmp_path):
    options = RunOptions(
        str(tmp_path / "run"), n_clusters=3, kmeans_starts=1, max_iter=5, embed_model="m",
        extract_hook=extract, embed_hook=embed, label_hook=label,
    )
    first = run_all(rows.filter("complaint_id < 100"), options)
    extracted, clustered, labelled, report = first.ledger
    assert (extracted["rows_in"], extracted["rows_out"], extracted["failed"]) == (100, 90, 10)
    assert extracted["total_topics"] == 180
    assert clustered["complaints"] == 90 and clustered["clusters"] == 3
    assert labelled["output_rows"] == 90 and labelled["clusters_using_fallback_name"] == labelled["clusters_labelled"] - 1
    assert report["input_rows"] == 90
    names = {r.general_topic_l1 for r in first.output.select("general_topic_l1").distinct().collect()}
    assert "Named" in names and names <= {"Named", "Theme 1", "Theme 2"}

    again = run_all(rows.filter("complaint_id < 120"), options).ledger[0]
    assert (again["resumed_from"], again["newly_processed"], again["rows_out"]) == (90, 18, 108)
    assert run_all(rows.filter("complaint_id < 120"), options).ledger[0]["newly_processed"] == 0
    stored = spark.read.parquet(str(tmp_path / "run" / "features"))
    assert stored.count() == 108  # only new texts were embedded


def test_defaults(spark, rows, tmp_path):
    options = RunOptions(str(tmp_path / "run"), n_clusters=4, kmeans_starts=1, max_iter=5, limit=60)
    result = run_all(rows, options)
    assert result.ledger[0]["rows_in"] == 60
    assert result.output.select("complaint_id").distinct().count() == result.output.count()
    made = dict(result.output.dtypes)
    for field in set(OUTPUT.fields) - set(INPUT.fields):
        assert made[field.name] == field.dataType.simpleString()
    assert set(result.reports) >= {"top_themes", "theme_by_product", "sentiment_shares", "monthly_trend"}
    assert ledger_table(spark, result.ledger).filter("measure = 'rows_in'").first().value == "60"


def test_topic_samples_keep_order(spark):
    rows = spark.createDataFrame(
        [(2, 0, ["c", "a"]), (1, 0, ["b", "a", "b"]), (3, 1, [f"t{i}" for i in range(20)]), (4, 2, [])],
        "complaint_id long, cluster_id int, all_topics_discussed array<string>",
    )
    got = {r.cluster_id: (r.sample_topics, r.sampled) for r in naming.topic_samples(rows).collect()}
    assert got == {0: ("b; a; c", 3), 1: ("; ".join(f"t{i}" for i in range(15)), 15)}


def test_fallback_label(spark):
    rows = spark.createDataFrame([(1, 0, ["a"]), (2, 5, ["b"])], "complaint_id long, cluster_id int, all_topics_discussed array<string>")
    labels = spark.createDataFrame([(0, "Fees"), (5, None)], "cluster_id int, label string")
    got = {r.cluster_id: r.general_topic_l1 for r in naming.label_rows(rows, labels).collect()}
    assert got == {0: "Fees", 5: "Theme 5"}


def test_key_phrases_by_definition(spark):
    import math
    import re
    from collections import Counter

    texts = {1: "late fees late fees charged", 2: "late fees again today", 3: "nothing here", 4: "", 5: None}
    rows = spark.createDataFrame(list(texts.items()), "complaint_id long, narrative string")
    grams = {}
    for key, text in texts.items():
        words = re.findall(r"[a-z]{4,}", text or "")
        grams[key] = Counter(" ".join(p) for p in zip(words, words[1:]))
    seen = Counter(p for g in grams.values() for p in g)
    want = {
        key: [p for _, p in sorted((-round(n * math.log(6 / (seen[p] + 1)), 6), p) for p, n in g.items())][:5]
        for key, g in grams.items() if g
    }
    got = {r.complaint_id: r.all_topics_discussed for r in ex.topic_lists(ex.key_phrases(rows)).collect()}
    assert got == want


def test_key_phrases_of_a_part_equal_those_of_the_whole(spark):
    texts = ["late fees late fees charged again", "late fees again today", "other late fees today again"]
    rows = spark.createDataFrame(list(enumerate(texts)), "complaint_id long, narrative string")
    whole = {tuple(r) for r in ex.key_phrases(rows).filter("complaint_id > 0").collect()}
    part = {tuple(r) for r in ex.key_phrases(rows.filter("complaint_id > 0"), corpus=rows).collect()}
    assert part == whole


def test_phrases_move_once_by_phrase_and_once_by_text(spark, rows, plan):
    text = plan(ex.key_phrases(rows))
    moves = [line for line in text.splitlines() if line.startswith("Arguments: hashpartitioning(")]
    assert sum("(phrase#" in m for m in moves) == 1 and sum("(complaint_id#" in m for m in moves) == 1
    assert "Join" not in text and "/phrases-" not in text  # nothing stored, counts are not moved
    whole = {tuple(r) for r in ex.key_phrases(rows).collect()}
    assert whole == {tuple(r) for r in ex.key_phrases(rows, corpus=rows).collect()}
