"""Row-local operators, exact deduplication and the pipeline on small fixtures."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from themescope.llm import bpe, decontaminate, exact_dedup, license_scan, quality, toxicity, warc
from themescope.llm.license_rules import rules
from themescope.llm.queries import ORACLES, QUERIES, vocabulary

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, small, name):
    import oracle

    assert oracle.difference(QUERIES[name](spark, small), oracle.connect(small), ORACLES[name]) is None


def test_names():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline"} == set(range(1, 14)) and "pipeline" in QUERIES


def test_archives_round_trip(spark):
    rows = [(1, "u", "x" * 300000, 0), (2, None, "x" * 300000, 0), (3, "v", None, 0), (4, "w", "", 0), (5, "z", "hé\r\n\r\n", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    got = {r["page_id"]: r for r in warc.round_trip(spark, pages).collect()}
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw)
        assert got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert got[2]["chunks"] == 5
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    files, _ = warc.archive(pages, warc.scratch_path(spark, "warc-test"))
    table = warc.read_records(files, chunk_bytes=1000).filter("page_key = 2").orderBy("chunk_no").collect()
    assert b"".join(r["chunk"] for r in table) == b"x" * 300000 and max(len(r["chunk"]) for r in table) == 1000
    assert [r["digest_so_far"] for r in table[:2]] == [
        base64.b32encode(hashlib.sha1(b"x" * n).digest()).decode() for n in (1000, 2000)]


def test_license_base_and_rules(spark):
    texts = ["Under the MIT license, under-the-mit LICENSE", "Apache License, Version 2.0", "cc by nc cc BY-NC", None, "", "no",
             "SPDX-License-Identifier: Apache-2.0", "licensed under the terms of the GNU General Public License version 3 or later",
             "under the Kit license", "x" * 50000 + " cc by nc"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(frame).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        hits = [(j, l) for p, l in license_scan.BASE.items() for j in range(len(w)) if w[j: j + len(p.split())] == p.split()]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(w), len(hits))
        assert (got[i]["first_word"], got[i]["last_word"]) == (min([j for j, _ in hits], default=None), max([j for j, _ in hits], default=None))
        assert got[i]["base_labels"] == ",".join(sorted({l for _, l in hits}))
        assert set(got[i]["base_labels"].split(",")) <= set(got[i]["labels"].split(",")) | {""} and 0 <= got[i]["score"] <= 1
    assert got[6]["labels"] == "apache-2.0" and got[7]["labels"] == "gpl-3.0"
    assert len(rules()) > 200 and license_scan.license_scan(frame.limit(0)).count() == 0


def test_exact_groups_odd_rows(spark):
    rows = [(1, "a b", 0), (2, "ab", 0), (3, "a  b\n", 0), (-4, None, 0), (5, " ", 0), (5, " ", 0), (None, "ab", 0)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()
    assert len(got) == 7 and sum(r["kept"] for r in got) == 2
    ab = [r for r in got if r["text_sha256"] == hashlib.sha256(b"ab").hexdigest()]
    assert {r["keep_id"] for r in ab} == {3} and {r["group_size"] for r in ab} == {4}
    frame = spark.createDataFrame([(-4, " "), (-9, "\t")], "doc_id long, text string")
    assert {r["keep_id"] for r in exact_dedup.exact_groups(frame).collect()} == {-9}
    assert exact_dedup.exact_groups(frame.limit(0)).count() == 0


def test_decontamination_blocks_and_short_items(spark, docs, small):
    bench = spark.createDataFrame([(1, "One two three"), (2, None), (3, " ".join("abcdefghijklm")), (10, "three")],
                                  "item_id long, text string")
    texts = ["x one TWO three y", "z a b c d e f g h i j k z", "a b c d e f g h i", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (1, 10_000):
        found = decontaminate.report(decontaminate.contamination(frame, bench, block_bytes=block))
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in found.collect()}
        assert got == {0: (5, 3, 2), 1: (13, 11, 1), 2: (9, 0, 0), 3: (0, 0, 0)}
    real = spark.read.parquet(f"{small}/benchmark.parquet")
    one = decontaminate.report(decontaminate.contamination(docs, real))
    many = decontaminate.report(decontaminate.contamination(docs, real, block_bytes=500))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert decontaminate.contamination(frame, bench.limit(0)).filter("size(items) > 0").count() == 0


def test_bpe_equals_the_public_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("word_bpe_49k.json")
    theirs = tokenizers.Tokenizer.from_file(path)
    texts = [r["text"] for r in docs.limit(60).collect()] + [
        None, "", "  It's  the ﬁrst\u0085İΣς x́<|endoftext|> 12½!!", "a" * 3000, "\x1c\x1d a\x1eb", "<|startoftext|>"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_decode(frame, path, with_ids=True, with_text=True).collect()}
    for i, t in enumerate(texts):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == theirs.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(frame.limit(0), path).count() == 0


def test_merges_are_leftmost_lowest():
    ranks = {(0, 1): (1, 3), (1, 2): (0, 4), (3, 0): (2, 5)}

    def plain(s):
        s = list(s)
        while True:
            best = min(((ranks[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks), default=None)
            if best is None:
                return s
            i = best[1]
            s[i: i + 2] = [ranks[s[i], s[i + 1]][1]]

    for n in range(3 ** 6):
        s = [n // 3 ** k % 3 for k in range(6)]
        assert bpe.merge_word(s, ranks) == plain(s)


def test_bpe_merges_short_words_together(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary("word_bpe_49k.json")
    theirs, ours, alone = tokenizers.Tokenizer.from_file(path), bpe.WordBpe(path), []
    merge_word = bpe.merge_word
    monkeypatch.setattr(bpe, "merge_word", lambda s, ranks: alone.append(len(s)) or merge_word(s, ranks))
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeo ES.,'½ä\n<") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += ["a" * 63 + " " + "ab" * 32 + " " + "aab" * 40, "x<|endoftext|>y <|startoftext|>", "", "It's we'll"]
    expected = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    for words in (bpe.REMEMBERED_WORDS, 50, 1):  # whatever a task remembers
        monkeypatch.setattr(bpe, "REMEMBERED_WORDS", words)
        monkeypatch.setattr(bpe, "FLAT_BYTES", 20 * words)
        for at in range(0, len(texts), 17):
            for (ids, plain), want in zip(ours.encode_texts(texts[at: at + 17]), expected[at: at + 17]):
                assert np.frombuffer(ids, "<u4").tolist() == want
                assert plain == theirs.decode(want, skip_special_tokens=False)
        assert len(ours.young[0]) <= words and all(len(chunk) <= bpe.REMEMBERED_LENGTH for chunk in ours.young[0])
    assert ours.encode(texts[-4]) == expected[-4]
    assert set(alone) == {120}  # long words only


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r["doc_id"]: r for r in labels.collect()}
    good = [(r["predicted"], truth[r["doc_id"]]["quality"]) for r in quality.quality(docs, labels).collect()
            if r["doc_id"] in truth and held(r["doc_id"])]
    assert sum(a == b for a, b in good) >= 0.97 * len(good)
    rows = [r for r in toxicity.toxicity(docs, labels).collect() if r["doc_id"] in truth and r["held_out"]]
    assert all(held(r["doc_id"]) for r in rows)
    bad = [r["score"] for r in rows if truth[r["doc_id"]]["toxic"]]
    fine = [r["score"] for r in rows if not truth[r["doc_id"]]["toxic"]]
    assert sum((x > y) + 0.5 * (x == y) for x in bad for y in fine) >= 0.85 * len(bad) * len(fine)  # some 350 toxic labels to learn from


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 0.0), (1, "", "en", "s", 0, 0.0), (None, "a b", "en", "s", -3, 1.0)],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double")
    none = spark.createDataFrame([(1, None, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.quality(docs, none).collect())
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(docs, none).collect())
    assert quality.quality(docs.limit(0), none).count() == 0 and toxicity.toxicity(docs.limit(0), none).count() == 0


def test_pipeline_keeps_what_its_stages_keep(spark, small, docs):
    import corpus_pipeline

    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, small).select("doc_id").collect()}
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, left = left, stage(spark, left, small)
        assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == ids and 0 < len(ids) < docs.count()
