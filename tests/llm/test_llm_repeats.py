"""Repeated substrings and passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from themescope.llm import phrase_dedup, repeats, substring_dedup


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(18, 90)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), rng.choice(["", "\n", " \t "]), text(rng.randint(0, 60))]
        out.append(" ".join(parts))
    out += [out[3], out[3], out[7].replace("a", "b", 3), "", None, "x" * 900, "ab" * 400, "one", shared[0], "a b " * 80]
    return list(enumerate(out))


def brute_bytes(rows, w=200):
    texts = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[j:j + w] for b in texts.values() for j in range(len(b) - w + 1))
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for j in range(len(b) - w + 1):
            if seen[b[j:j + w]] > 1:
                gone[j:j + w] = b"\1" * w
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, w=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for j in range(len(words) - w + 1):
            piece = tuple(words[j:j + w])
            if piece in seen:
                gone.update(range(j, j + w))
            seen.add(piece)
        kept = " ".join(x for j, x in enumerate(words) if j not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [500, 0])
def test_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "x").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.report(substring_dedup.remove_repeats(docs)).collect()}
    assert got == brute_bytes(rows)
    got = {r[0]: tuple(r)[1:] for r in phrase_dedup.report(phrase_dedup.remove_recurring(docs)).collect()}
    assert got == brute_words(rows)


def test_odd_rows(spark):
    long = "z" * 250
    rows = [(None, long, 1), (1, long, 2), (1, long, 2), (2, None, 3), (2, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lo long")
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == 5 and sorted(r["n_removed"] for r in got) == [0, 0, 250, 250, 250]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    text = " ".join(map(str, range(25)))
    docs = spark.createDataFrame([(None, text), (3, text), (3, text)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in phrase_dedup.remove_recurring(docs).collect()) == [0, 25, 25]
    assert phrase_dedup.remove_recurring(docs.limit(0)).count() == 0


def test_cut_takes_removed_bytes_out(spark):
    a = "".join(chr(97 + i * i % 23) for i in range(300))
    docs = spark.createDataFrame([(1, "start " + a + " end", "q"), (2, a + "tail", "r")], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["text"] for r in substring_dedup.cut(docs, substring_dedup.remove_repeats(docs)).collect()}
    assert out == {1: "start  end", 2: "tail"}
