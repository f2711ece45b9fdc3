"""The exchange of co-training, on made views of known use, and on whole documents."""

from __future__ import annotations

import numpy as np
import pytest

from themescope.llm import quality as q


def made(seed: int, rows: int, informative: bool):
    rng = np.random.default_rng(seed)
    y = (rng.random(rows) < 0.6).astype(float)
    text, meta = rng.normal(size=(rows, q.TEXT_WIDTH)), rng.normal(size=(rows, q.META_WIDTH))
    text[:, :10] += 0.5 * (2 * y - 1)[:, None]
    if informative:
        meta[:, 0] += 1.6 * (2 * y - 1)
    return text, meta, y


def right(model: q.Model, text, meta, y) -> np.ndarray:
    """Shares of right answers: text view, metadata view, both."""
    margins = [c.margin(v.margin(x)[:, None]) for v, c, x in
               ((model.text, model.text_curve, text), (model.meta, model.meta_curve, meta))]
    margins.append(model.both.margin(np.column_stack(margins)))
    return np.array([((m > 0) == (y > 0.5)).mean() for m in margins])


def mean_right(rounds: int, informative: bool) -> np.ndarray:
    out = []
    for seed in range(4):
        text, meta, y = made(seed, 2000, informative)
        label = np.where(np.arange(2000) < 90, y, np.nan)
        out.append(right(q.co_train(text, meta, label, rounds), *made(seed + 50, 3000, informative)))
    return np.mean(out, axis=0)


def test_an_informative_view_teaches_the_other():
    alone, together = mean_right(0, True), mean_right(4, True)
    assert together[0] > alone[0] + 0.01 and together[1] > alone[1] + 0.05 and together[2] > alone[2] + 0.02


def test_a_view_without_knowledge_does_little_harm():
    assert (mean_right(4, False) > mean_right(0, False) - 0.03).all()


def test_labels_cross_both_ways_and_grow():
    text, meta, y = made(1, 2000, True)
    found = q.co_train(text, meta, np.where(np.arange(2000) < 150, y, np.nan)).exchanges
    assert len(found) == 2 * q.ROUNDS
    for teacher in ("meta", "text"):
        turns = [e for e in found if e.teacher == teacher]
        told = [e.good + e.bad for e in turns]
        assert told == sorted(told) and min(min(e.good, e.bad) for e in turns) > 0 and turns[0].weight > 0


@pytest.mark.parametrize("label", [[], [1.0], [np.nan] * 5, [1.0, 0.0, np.nan], [1.0] * 9 + [np.nan] * 4])
def test_few_labels_or_none_train_a_model(label):
    rows = len(label)
    model = q.co_train(np.zeros((rows, q.TEXT_WIDTH)), np.zeros((rows, q.META_WIDTH)), np.array(label, float))
    assert np.isfinite(right(model, *made(3, 20, True))).all()


def test_equal_scores_are_told_in_row_order():
    label, weight = q._told(np.full(10, 0.8), 0.5, 0.5)
    assert np.nansum(label) == 2 and np.isnan(label[2:]).all() and (weight[:2] > 0).all() and (weight[2:] == 0).all()


def test_odd_rows_pass(spark):
    """Missing and repeated rows, a language and a source that clash with names of results."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 60_000, "de", None, 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS label", "'x' AS score", "2 AS turn", "3 AS predicted")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = q.quality(docs, labels).collect()
    assert len(got) == 4 and sorted(r["doc_id"] or 0 for r in got) == [0, 1, 1, 2]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= q.THRESHOLD) for r in got)
