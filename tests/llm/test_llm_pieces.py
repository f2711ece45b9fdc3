"""SentencePiece encoding by merge rounds against the public library, text by text."""

import hashlib
import random

import pytest

from themescope.llm import piece_bpe
from themescope.llm.queries import vocabulary

sentencepiece = pytest.importorskip("sentencepiece")
PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def ours():
    return piece_bpe.PieceBpe(PATH)


def made_texts():
    draw = random.Random(12)
    letters = ["abcdeinrst  ", "abc XYZ019.,-()'\n\t ", "éüñçß ÄÖ", "한국어中文字😀 ", "▁ ▁a", " ", "ab", "\r\n){;*/ ", "аеиноу стр",
               "\x00\x1c　\xa0 a"]
    texts = ["".join(draw.choice(draw.choice(letters)) for _ in range(draw.randrange(60))) for _ in range(1500)]
    for alphabet in letters:
        texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(40))) for _ in range(100)]
    return texts + ["", " ", "\n", "<s>", "<0x0A>", "</s> <unk>", "�", "x" * 40]


def test_ids_and_texts_equal_the_library(library, ours):
    texts = made_texts()
    for text, (n, ids, decoded) in zip(texts, ours.encode_texts(texts)):
        want = library.encode(text)
        assert ids == ",".join(map(str, want)) and n == len(want), text
        assert decoded == library.decode(want) == ours.decode(want), text


def test_very_long_words(library, ours):
    draw = random.Random(3)
    for text in ("a" * 50_000, "ab" * 20_000, " " * 3000, "é" * 2000,
                 "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))):
        assert ours.encode(text) == library.encode(text)


def test_any_ids_decode_like_the_library(library, ours):
    draw = random.Random(5)
    for _ in range(4000):
        ids = [draw.choice([draw.randrange(300), draw.randrange(32000), 3 + draw.randrange(256), 28705])
               for _ in range(draw.randrange(8))]
        assert ours.decode(ids) == library.decode(ids), ids


def test_results_do_not_depend_on_the_memory(library, ours, monkeypatch):
    monkeypatch.setattr(piece_bpe, "REMEMBERED_BYTES", 1)
    monkeypatch.setattr(piece_bpe, "FLAT_POINTS", 7)
    texts = made_texts()[:200]
    for text in texts:
        assert ours.encode(text) == library.encode(text)


def test_table(spark, library):
    rows = [(1, "some words", "x"), (1, "some words", "x"), (None, None, None), (2, "", "y"), (3, "long " * 40_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = piece_bpe.encode_decode(docs.withColumnRenamed("n_tokens", "ids"), PATH, with_text=True).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in got) == sorted(
        (i is None, i, len(library.encode(t or ""))) for i, t, _ in rows)
    for r in got:
        text = {1: "some words", 3: "long " * 40_000}.get(r.doc_id, "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, library.encode(text))).encode()).hexdigest()
        assert r.decoded == text and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    kept = piece_bpe.encode_decode(docs.withColumnRenamed("n_tokens", "source"), PATH, keep=("source",))
    assert {r.source for r in kept.collect()} == {"x", "y", "z", None}
    empty = piece_bpe.encode_decode(docs.limit(0), PATH, with_ids=True)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
