"""Quality classification by co-training.

Two views of a document, its text and its page metadata, each get a classifier of their own.  In each
round both label the unlabelled part of a bounded sample, and each is told what the *other* is surest
about: the first rows of each class by calibrated probability, more of them from round to round.  A told
label counts by its evidence, the way the teacher's probability has moved from the share of the class, and by
the teacher's skill on held-back rows, so a view that knows nothing misleads little.  At the end both are calibrated and combined on labelled rows that
took no part, and all documents are scored in one narrow pass.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themescope.llm.common import groups_of_rows, text_buffer
from themescope.llm.hashing import Words
from themescope.llm.logistic import Logistic, fit_logistic

#: Rows of each kind (labelled good, labelled bad, unlabelled) that training looks at, at most; in order of
#: the hash of their id.
SAMPLE_ROWS = 6_000
ROUNDS = 4
#: A told label weighs at most this much of a given one.
TOLD_WEIGHT = 0.5
#: A document whose score is below this is rejected.
THRESHOLD = 0.5
_SLOTS = 16


class Exchange(NamedTuple):
    """What one view told the other in a round: labels of each class and the weight they had in sum."""

    turn: int
    teacher: str
    good: int
    bad: int
    weight: float


class Model(NamedTuple):
    """Classifiers of both views with their calibration, the curve that combines them, and the exchange."""

    text: Logistic
    text_curve: Logistic
    meta: Logistic
    meta_curve: Logistic
    both: Logistic
    exchanges: tuple[Exchange, ...] = ()


TEXT_WIDTH, META_WIDTH = 20, 3 + 4 * _SLOTS


def text_view(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[float]:
    """Shape of a text: kinds of bytes, repetition of words, lengths."""
    n = max(1, len(raw))
    kinds = np.bincount(raw, minlength=256)
    letters = kinds[97:123].sum() + kinds[128:].sum()
    upper = kinds[65:91].sum()
    words = max(1, len(hashes))
    lengths = ends - starts
    _, counts = np.unique(hashes, return_counts=True)
    again = float((hashes[1:] == hashes[:-1]).mean()) if len(hashes) > 1 else 0.0
    distinct = len(counts) / words
    expected = min(1.0, 3.0 * words ** -0.25)  # distinct share falls with length
    # repetition within stretches of 64 words, so that a bad passage shows in a long text
    stretch = [len(np.unique(hashes[i: i + 64])) / len(hashes[i: i + 64]) for i in range(0, len(hashes), 64)
               if len(hashes[i: i + 64]) >= 16] or [1.0]
    marks = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum() - kinds[[39, 44, 45, 46]].sum()
    return [
        letters / n, upper / n, kinds[48:58].sum() / n, kinds[32] / n, kinds[10] / n, marks / n, marks / words,
        kinds[33] / words, kinds[124] / words, kinds[35:39].sum() / words, (kinds[44] + kinds[46]) / words,
        upper / max(1, upper + letters), again, distinct, distinct / expected, min(stretch), float(np.mean(stretch)),
        counts.max() / words if len(counts) else 0.0, float(lengths.mean()) if len(lengths) else 0.0, math.log1p(words)]


def meta_view(lang: str | None, source: str | None, size: int | None) -> list[float]:
    """Language, source and recorded length of a page, without its text: each by itself, and the length
    within its language and within its source."""
    out = [0.0] * META_WIDTH
    out[0] = math.log1p(max(0, size or 0))
    out[1] = out[0] ** 2 / 10
    out[2] = float(size is None)
    for k, name in enumerate((lang, source)):
        slot = 3 + 2 * k * _SLOTS + zlib.crc32((name or "").encode("utf-8", "surrogatepass")) % _SLOTS
        out[slot], out[slot + _SLOTS] = 1.0, out[0]
    return out


def _views(batch: pa.RecordBatch, text_col: str, lang_col: str, source_col: str, size_col: str):
    """Row ranges of a batch with both views."""
    data, offsets = text_buffer(batch.column(text_col))
    lang, source, size = (batch.column(c).to_pylist() for c in (lang_col, source_col, size_col))
    for a, b in groups_of_rows(offsets, 1 << 21):
        at = offsets[a: b + 1]
        words = Words(data[at[0]: at[-1]], at - at[0], "visible", lower=True)
        text = np.array([text_view(data[at[i]: at[i + 1]], words.start[words.row[i]: words.row[i + 1]],
                                   words.end[words.row[i]: words.row[i + 1]], words.hash[words.row[i]: words.row[i + 1]])
                         for i in range(b - a)])
        yield a, b, text, np.array([meta_view(lang[i], source[i], size[i]) for i in range(a, b)])


def _curve(classifier: Logistic, x: np.ndarray, y: np.ndarray) -> Logistic:
    return fit_logistic(classifier.margin(x)[:, None], y)


def _calibrated(classifier: Logistic, curve: Logistic, x: np.ndarray) -> np.ndarray:
    return curve.probability(classifier.margin(x)[:, None])


def _skill(margin: np.ndarray, y: np.ndarray) -> float:
    """How far a view ranks held-back rows better than chance, less one standard error of chance: 0 to 1."""
    good, bad = margin[y > 0.5], np.sort(margin[y < 0.5])
    if not len(good) or not len(bad):
        return 0.0
    area = (np.searchsorted(bad, good) + np.searchsorted(bad, good, side="right")).mean() / (2 * len(bad))
    error = math.sqrt((len(y) + 1) / (12 * len(good) * len(bad)))
    return float(np.clip(2 * (area - 0.5 - error), 0.0, 1.0))


def _told(p: np.ndarray, share: float, part: float) -> tuple[np.ndarray, np.ndarray]:
    """Labels (NaN: none) and weights for the surest ``part`` of each class; ``share`` is that of the ones.

    A label weighs by how far its probability lies beyond the share of its class, from 0 (as expected of any
    row) to 1; rows that are no likelier of the class than any other are not told.
    """
    order = np.argsort(-p, kind="stable")
    label, weight = np.full(len(p), np.nan), np.zeros(len(p))
    for rows, one, base, likely in ((order, 1.0, share, p), (order[::-1], 0.0, 1.0 - share, 1.0 - p)):
        rows = rows[: max(1, int(len(p) * base * part))]
        gain = (likely[rows] - base) / max(1e-9, 1.0 - base)
        label[rows[gain > 0]], weight[rows[gain > 0]] = one, gain[gain > 0]
    return label, weight


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``label`` is 1, 0 or NaN.  Every third labelled row is kept for calibration.  Round r of ``rounds`` tells
    the surest r / rounds of the unlabelled rows of each class, up to half of them; with no rounds each view
    learns alone."""
    known = np.flatnonzero(~np.isnan(label))
    held, fit, free = known[::3], np.setdiff1d(known, known[::3]), np.flatnonzero(np.isnan(label))
    share = (float(label[held].sum()) + 0.5) / (len(held) + 1.0)
    told = [(np.full(len(free), np.nan), np.zeros(len(free)))] * 2  # what each view has been told
    exchanges: list[Exchange] = []
    for turn in range(rounds + 1):
        views, curves = [], []
        for x, (other, trust) in zip((text, meta), told):
            more = np.flatnonzero(~np.isnan(other))
            rows = np.concatenate([x[fit], x[free[more]]])
            y = np.concatenate([label[fit], other[more]])
            weight = np.concatenate([np.ones(len(fit)), TOLD_WEIGHT * trust[more]])
            views.append(fit_logistic(rows, y, weight))
            curves.append(_curve(views[-1], x[held], label[held]))
        if turn == rounds or not len(free):
            break
        told = []
        for name, k, x in (("meta", 1, meta), ("text", 0, text)):  # the text view is told by the metadata view
            other, trust = _told(_calibrated(views[k], curves[k], x[free]), share, (turn + 1) / rounds / 2)
            trust = trust * _skill(views[k].margin(x[held]), label[held])
            other = np.where(trust > 0, other, np.nan)
            told.append((other, trust))
            exchanges.append(Exchange(turn + 1, name, int((other == 1).sum()), int((other == 0).sum()),
                                      round(float(trust.sum()), 3)))
    pair = np.column_stack([curves[0].margin(views[0].margin(text[held])[:, None]),
                            curves[1].margin(views[1].margin(meta[held])[:, None])]).reshape(-1, 2)
    return Model(views[0], curves[0], views[1], curves[1], fit_logistic(pair, label[held]), tuple(exchanges))


def held_out(key):
    return (F.crc32(key.cast("string").cast("binary")) % 5) == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars",
                label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """A model from at most ``sample_rows`` documents of each kind: good, bad, without label.

    Labels whose crc32 of the id as text is divisible by 5 are not used.  Several labels of an id count as
    their smallest; missing ids and labels are left out.  Only the numbers of both views come to the driver.
    """
    given = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(id_col).agg(F.min(label_col).cast("double").alias("label")))
    order = F.xxhash64(F.col(id_col).cast("string"))
    usable = given.filter(~held_out(F.col(id_col)))
    picked = [usable.filter(F.col("label") == k).orderBy(order, id_col).limit(sample_rows) for k in (0, 1)]
    bare = (docs.select(id_col).filter(F.col(id_col).isNotNull()).join(given.select(id_col), id_col, "left_anti")
            .orderBy(order, id_col).limit(sample_rows).select(id_col, F.lit(None).cast("double").alias("label")))
    ids = F.broadcast(picked[0].unionByName(picked[1]).unionByName(bare))  # at most 3 * sample_rows ids
    rows = docs.select(id_col, text_col, lang_col, source_col, F.col(size_col).cast("long").alias(size_col)).join(ids, id_col)
    rows = rows.withColumn("turn", order)

    def run(batches):
        for batch in batches:
            for a, b, text, meta in _views(batch, text_col, lang_col, source_col, size_col):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("turn").slice(a, b - a), batch.column("label").slice(a, b - a),
                     pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))],
                    names=["turn", "label", "text", "meta"])

    got = sorted(rows.select("turn", "label", text_col, lang_col, source_col, size_col)
                 .mapInArrow(run, "turn long, label double, text array<double>, meta array<double>").collect(),
                 key=lambda r: (r["turn"], r["text"]))
    return co_train(np.array([r["text"] for r in got]).reshape(-1, TEXT_WIDTH),
                    np.array([r["meta"] for r in got]).reshape(-1, META_WIDTH),
                    np.array([np.nan if r["label"] is None else r["label"] for r in got], np.float64), rounds)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", size_col: str = "n_chars", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns of ``keep``, text_score, meta_score and score (all 0 to 1) of every row.

    A missing text, language, source or length counts as empty or as a value of its own; repeated rows,
    missing ids and other columns pass as they are; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    wide = docs.select(*dict.fromkeys([id_col, *keep, text_col, lang_col, source_col, size_col]))
    fields = wide.select(*dict.fromkeys([id_col, *keep])).schema
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields],
                        "text_score double, meta_score double, score double"])

    def run(batches):
        m = sent.value
        for batch in batches:
            for a, b, text, meta in _views(batch, text_col, lang_col, source_col, size_col):
                margins = [m.text.margin(text)[:, None], m.meta.margin(meta)[:, None]]
                pair = np.column_stack([m.text_curve.margin(margins[0]), m.meta_curve.margin(margins[1])])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f.name).slice(a, b - a) for f in fields], pa.array(m.text_curve.probability(margins[0])),
                     pa.array(m.meta_curve.probability(margins[1])), pa.array(m.both.probability(pair))],
                    names=[*fields.names, "text_score", "meta_score", "score"])

    return wide.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), threshold: float = THRESHOLD,
            sample_rows: int = SAMPLE_ROWS, **columns: str) -> DataFrame:
    """Scores of :func:`score_quality` and ``predicted`` (1: kept) for every row of ``docs``."""
    label = {"label_col": columns.pop("label_col")} if "label_col" in columns else {}
    model = fit_quality(docs, labels, sample_rows=sample_rows, **columns, **label)
    scored = score_quality(docs, model, keep=keep, **columns)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
