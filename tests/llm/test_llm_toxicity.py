"""Toxicity on few labels, and texts whose only evidence is far inside."""

import random

from themescope.llm import toxicity


def scores(docs, labels):
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [(r["score"], truth[r["doc_id"]]) for r in toxicity.toxicity(docs, labels).collect()
            if r["held_out"] and truth.get(r["doc_id"]) is not None]
    return [s for s, k in rows if k], [s for s, k in rows if not k]


def quality(bad, fine):
    area = sum((x > y) + 0.5 * (x == y) for x in bad for y in fine) / (len(bad) * len(fine))
    right = (sum(s >= 0.5 for s in bad) + sum(s < 0.5 for s in fine)) / (len(bad) + len(fine))
    return area, right, sum(s >= 0.5 for s in bad) / len(bad)


def test_few_labels(spark):
    folder = "/root/testdata/sf0.1"
    area, right, recall = quality(*scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")))
    assert area >= 0.9 and right >= 0.93 and recall >= 0.5, (area, right, recall)


def test_a_passage_anywhere_in_a_long_text(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(9000 if i % 3 == 0 else 60)]
        if i % 4 == 0:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(["zorblax", "quxnard"]) for _ in range(8)]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    area, right, recall = quality(*scores(docs.repartition(8), known))
    assert area >= 0.99 and recall >= 0.95, (area, right, recall)
