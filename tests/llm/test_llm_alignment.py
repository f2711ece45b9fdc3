"""Alignment of two tokenizers against byte offsets counted one by one."""

import collections
import hashlib
import random

import numpy as np
import pytest

from themescope.llm import alignment
from themescope.llm.bpe import byte_letters
from themescope.llm.queries import vocabulary

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")
A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


class Plain:
    """Whole texts through the two libraries, every token against every other."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.letters = {c: i for i, c in enumerate(byte_letters())}

    def tokens(self, text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i)))
             for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
              else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return [], []
        return a, b

    def links(self, a, b):
        out, at = [], 0
        spans = []
        for i, x in b:
            spans.append((at, at + len(x), i))
            at += len(x)
        at = low = 0
        for i, x in a:
            end = at + len(x)
            while low < len(spans) and spans[low][1] <= at:
                low += 1
            k = low
            while k < len(spans) and spans[k][0] < end:
                out.append((i, spans[k][2]))
                k += 1
            at = end
        return out

    def groups(self, a, b):
        out, left, right, at_a, at_b = [], [], [], 0, 0
        rest = list(b)
        for i, x in a:
            left.append(i)
            at_a += len(x)
            while rest and at_b + len(rest[0][1]) <= at_a:
                j, y = rest.pop(0)
                right.append(j)
                at_b += len(y)
            if at_a == at_b:
                out.append((left, right))
                left, right = [], []
            elif rest and at_b < at_a:
                pass
        return out

    def all(self, rows):
        tokens = [self.tokens(t) for _, t in rows]
        links = [self.links(a, b) for a, b in tokens]
        count = collections.Counter(p for found in links for p in set(found))
        top = collections.defaultdict(int)
        for (a, _), n in count.items():
            top[a] = max(top[a], n)
        out = []
        for (i, _), (a, b), found in zip(rows, tokens, links):
            groups = self.groups(a, b)
            line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
            out.append((i, len(a), len(b), len(groups), len(found), sum(count[p] == top[p[0]] for p in found),
                        sum(count[p] for p in found), hashlib.sha256(line.encode()).hexdigest() if a else ""))
        return out


def made_texts(n):
    draw = random.Random(13)
    letters = ["abcdeinrst   ", "abc XYZ019.,-()'\n\t ", "éüñçß ÄÖ", "한국어中文字😀 ", " ", "\r\n){;*/ ", "аеиноу стр",
               "\x00\x1c　\xa0 a \x85", "\n a", "\n\n a"]
    words = "the of and don't we'll it's 2024 10,000 tokenisation <|endoftext|> <s> </s> Straße naïve 北京   x".split(" ")
    texts = ["".join(draw.choice(draw.choice(letters)) for _ in range(draw.randrange(60))) for _ in range(n)]
    texts += ["".join(draw.choice(a) for _ in range(draw.randrange(40))) for a in letters for _ in range(n // 10)]
    texts += [draw.choice([" ", "  ", "\n", " \n", "\n\n", "\n "]).join(draw.choice(words) for _ in range(draw.randrange(30)))
              for _ in range(n)]
    return [*texts, "", " ", "\n", "\n\n", "a\n", "\na", "a▁b", "▁", "a <0x0A> b", "a b ", "a\n\nb", "a\n\n\n b"]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_equals_brute_force(spark, plain):
    rows = [*enumerate(made_texts(300)), (3, "repeated id"), (None, "missing id"), (None, None), (-4, "the end " * 9000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, block string")
    got = alignment.align(docs.repartition(3), A, B)
    assert order(map(tuple, got.collect())) == order(plain.all(rows))


def test_blocks_and_memory_do_not_matter(spark, plain, monkeypatch):
    """Small blocks, plain bits and a memory that is emptied all the time, in this process."""
    rows = list(enumerate(made_texts(60)))
    monkeypatch.setattr(alignment, "REMEMBERED_BYTES", 1)
    aligner = alignment.Aligner(A, B)
    want = plain.all(rows)
    for i, text in rows:
        numbers, lines, pair, doc, times = aligner.align([text])
        assert tuple(numbers[0]) == want[i][1:5], text
        assert (hashlib.sha256(lines[0].encode()).hexdigest() if lines[0] else "") == want[i][7], text
        links = collections.Counter(plain.links(*plain.tokens(text)))
        a, b = aligner.ids(pair)
        assert dict(zip(zip(a.tolist(), b.tolist()), times.tolist())) == links


def test_planes_hold_all_counts():
    draw = np.random.default_rng(2)
    n_docs = 100
    seen = draw.integers(0, 40, (50, n_docs)) * (draw.random((50, n_docs)) < draw.random((50, 1)))
    pair, doc = np.nonzero(seen)
    found = alignment.postings(pair.astype(np.int64), doc, seen[pair, doc], n_docs)
    assert set(found.column("dense").to_pylist()) == {False, True}
    planes, dense = found.column("plane").to_numpy(), np.array(found.column("dense").to_pylist())
    bits, values = found.column("bits").to_pylist(), found.column("pair").to_numpy() + 1
    want = (seen * (np.arange(50)[:, None] + 1)).sum(0)
    assert alignment.add_up(n_docs, planes, dense, bits, values).tolist() == want.tolist()
    popcounts = {a: sum(bin(x).count("1") for x in b) if d else len(b) // 2
                 for a, p, d, b in zip(found.column("pair").to_pylist(), planes, dense, bits) if p == 0}
    assert popcounts == {i: int((seen[i] > 0).sum()) for i in range(50) if (seen[i] > 0).any()}


def test_dense_postings_in_spark(spark, plain):
    """Most documents hold the same pair, so its bitmaps are plain bits."""
    rows = [(i, "the cat " * (i % 7) + f"word{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(2)
    assert order(map(tuple, alignment.align(docs, A, B).collect())) == order(plain.all(rows))


def test_empty_table(spark):
    got = alignment.align(spark.createDataFrame([], "doc_id string, text string, extra int"), A, B)
    assert got.collect() == []
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
