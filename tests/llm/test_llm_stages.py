"""Stages of the pipeline against brute force."""

import random
import re

import pytest

import corpus_pipeline
from themescope.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def near_kept(rows, n=5, percent=80):
    """Ids of the rows with the smallest id of their group."""
    def tokens(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return frozenset(tuple(words[i: i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()

    sets = {i: tokens(t) for i, t in rows}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return {i for i in sets if label[i] == i}


def near_corpus():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(3000)]
    out = []
    for size in (1, 4, 5, 6, 50, 120, 176, 190, 204, 300):
        for _ in range(2):
            base = [rng.choice(words) for _ in range(size)]
            out.append(" ".join(base))
            for _ in range(8):  # one changed word in every 30 to 60, or more words behind
                copy = list(base)
                for at in range(rng.randrange(30), size, rng.randint(30, 60)):
                    copy[at] = rng.choice(words)
                out.append(" ".join(copy + [rng.choice(words) for _ in range(rng.choice([0, 0, size // 8, size // 4]))]))
    out += ["", None, " \t"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("frequent", [16, 1])
def test_near_copies_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = near_corpus()
    # all tokens of the pair are frequent, the sizes stand on both sides of the largest combined one
    rng = random.Random(7)
    base = ["x%d" % rng.randrange(10 ** 6) for _ in range(176)]
    rows += [(1000, " ".join(base)), (1001, " ".join(base + ["y%d" % i for i in range(40)]))]
    edge = jaccard.combined_size(80)
    for at, size in enumerate((edge, edge + 4, edge + 8, edge + 10)):  # shingles are four fewer than words
        rows += [(1002 + at, " ".join("z%d" % i for i in range(size)))]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()}
    assert kept == near_kept(rows)
    assert kept != near_kept(rows, 3, 90) and 1001 not in kept


def test_rows_with_missing_and_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def left(stage, rows):
        return sorted(((r["doc_id"], r["text"]) for r in stage(spark, frame(spark, rows), str(tmp_path)).collect()), key=str)

    long, other = " ".join("l%d" % i for i in range(60)), " ".join("o%d" % i for i in range(60))
    near = long.replace("l59", "changed")
    rows = [(None, other), (None, "alone"), (1, long), (1, long), (1, "first"), (2, long), (2, "second"), (3, None)]
    once = [(None, other), (None, "alone"), (1, long), (1, "first"), (2, "second"), (3, None)]
    assert left(corpus_pipeline.drop_copies, rows) == sorted(once, key=str)
    assert left(corpus_pipeline.drop_near_copies, rows + [(1, near), (2, other)]) in [
        sorted([x for x in once if x != (1, long)] + [(1, t)], key=str) for t in (long, near)]
    bad = "x one two three y"
    rows = [(None, "good"), (None, bad), (1, bad), (1, "good"), (1, "good"), (2, bad), (3, None)]
    assert left(corpus_pipeline.drop_contaminated, rows) == sorted([x for x in rows if x[1] != bad], key=str)
