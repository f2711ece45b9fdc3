"""Similar documents against brute force."""

import random
import re

import pytest

from themescope.llm import jaccard


def brute(rows):
    def tokens(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not words:
            return frozenset()
        return frozenset(zip(words, words[1:], words[2:])) if len(words) > 2 else frozenset([tuple(words)])

    sets = {i: tokens(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = random.Random(11)
    words = ["w%d" % i for i in range(400)] + ["É", "Ab", "ab"]
    out = []
    for size in (1, 2, 3, 5, 30, 150, 260):
        for _ in range(3):
            base = [rng.choice(words) for _ in range(size)]
            out.append(" ".join(base))
            for _ in range(30 if size == 150 else 6):
                copy = list(base)
                for _ in range(rng.randint(0, 4)):
                    copy[rng.randrange(size)] = rng.choice(words)
                out.append(rng.choice([" ", "\n"]).join(copy))
    common = " ".join(rng.choice(words) for _ in range(12))
    out += [common + " " + " ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    out += ["", None, " \t", "Ab c", "aB C", "ab"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("frequent", [16, 2])
def test_equals_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (5, None, 3)], "doc_id long, text string, c long")
    got = sorted((r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs).collect() if r["n_shingles"])
    assert got == [(2, None), (2, None)]
    assert jaccard.similar_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [90, 80])
def test_only_pairs_that_can_link_leave_a_rare_token(spark, monkeypatch, percent):
    rng = random.Random(7)
    passages = [[f"p{k}.{i}" for i in range(30)] for k in range(20)]
    rows = []
    for k in range(20):  # eight texts share a passage, two of them nearly all
        base = passages[k] + [f"b{k}.{i}" for i in range(400)]
        rows += [" ".join(base), " ".join(base[:-1])]
        rows += [" ".join(passages[k] + [f"w{k}.{j}.{i}" for i in range(rng.randint(100, 600))]) for j in range(6)]
    tables = {}
    stored = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: tables.setdefault(name, []).append(stored(df, name)) or tables[name][-1])
    monkeypatch.setattr(jaccard, "ORDERED_TOKENS", 1)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs, percent=percent).collect()}
    assert got == {i: i - 1 if i % 8 == 1 else i for i in range(160)}
    marked = tables["jaccard-marked"][0]
    room = {(r["a"], r["b"]) for r in tables["jaccard-pairs"][0].collect()}
    assert marked.filter("other IS NULL AND NOT often").count() <= 8 * jaccard.ORDERED_TOKENS
    assert {(r["c"], r["other"]) for r in marked.filter("other IS NOT NULL").collect()} <= room
    assert len(room) < 20 * 8 * 7 // 2 and tables["jaccard-keys"][0].count() <= 8 * jaccard.ORDERED_TOKENS
    widest = tables["jaccard-sets"][0].filter("n IS NOT NULL").selectExpr("max(size(sketch))").collect()[0][0]
    assert widest == (8 if percent == 90 else 16)  # four bits for each of 66 or 139 tokens


def test_sketches_never_rule_out_a_similar_pair():
    rng = random.Random(3)
    for percent in (90, 80, 100):
        for size in (1, 2, 40, 300, 640, 1300, 5000):
            a = {rng.getrandbits(64) for _ in range(size)}
            for _ in range(20):
                b = set(a)
                while 100 * len(a & b) >= percent * len(a | b):
                    x, y = (jaccard._sketch(jaccard.np.array(sorted(t), "u8"), percent) for t in (a, b))
                    width = min(len(x), len(y))
                    x, y = (t if len(t) == width else t[:width] ^ t[width:] for t in (x, y))
                    apart = sum(int(w).bit_count() for w in (x ^ y).view("u8"))
                    assert apart <= len(a ^ b)
                    if rng.random() < 0.5:
                        b -= set(rng.sample(sorted(b), max(1, len(b) // 40)))
                    if not b or rng.random() < 0.5:
                        b |= {rng.getrandbits(64) for _ in range(max(1, size // 40))}
