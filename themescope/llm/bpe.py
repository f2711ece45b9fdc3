"""Byte-pair encoding with word ends, and its decoding.

A slice of texts is cut into runs without white space; every distinct run that is not remembered, and in it
every distinct word, is encoded once.  Short words are merged side by side in one flat array.  A long word's
symbols are leaves of a segment tree over the ranks of adjacent pairs.  The root names the leftmost pair of
lowest rank; merging it changes two neighbouring pairs, so each merge costs a few point updates of logarithmic
depth, until the root holds no rank at all.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import hashlib
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from themescope.llm.common import groups_of_rows, text_buffer
from themescope.llm.merges import INSIDE, WIDTH, Merges

_NONE = 1 << 60

# The vocabulary's library classes characters by older Unicode tables than the regex
# module, and lower-cases by newer ones than Python.
_NOT_LETTERS = [
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f),
    (0xa7ce, 0xa7cf), (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1),
    (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee),
    (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11df1, 0x11df1), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3),
    (0x16ff2, 0x16ff3), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2),
    (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6),
    (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de),
    (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff),
    (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
]
_NOT_NUMBERS = [(0x11de0, 0x11de9), (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ff4, 0x16ff6)]
_LATER_LOWER = {
    0x1c89: 0x1c8a, 0xa7cb: 0x264, 0xa7cc: 0xa7cd, 0xa7ce: 0xa7cf, 0xa7d2: 0xa7d3, 0xa7d4: 0xa7d5, 0xa7da: 0xa7db,
    0xa7dc: 0x19b, **{c: c + 0x20 for c in range(0x10d50, 0x10d66)}, **{c: c + 0x1b for c in range(0x16ea0, 0x16eb9)},
}
#: Runs without white space of which a task remembers the ids, in each half of its memory.
REMEMBERED_WORDS = 200_000
#: Longer ones are forgotten after each slice.
REMEMBERED_LENGTH = 64
#: Bytes of a word that is merged along with others, in rounds.
SHORT_WORD = 64
#: Bytes of words merged at once.
FLAT_BYTES = 1 << 20


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge adjacent pairs, lowest rank first and leftmost among equals, until none has a rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    found = list(map(get, zip(symbols, symbols[1:])))
    if n == 2:
        return [found[0][1]] if found[0] else symbols
    size = 1 << (n - 2).bit_length()
    # leaves: rank and place of each pair as one number, so the place decides between equal ranks
    tree = [_NONE] * size
    tree += [got[0] * n + i if got else _NONE for i, got in enumerate(found)]
    tree += [_NONE] * (2 * size - len(tree))
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    symbols = list(symbols)
    while tree[1] < _NONE:
        i = tree[1] % n
        j = after[i]
        symbols[i] = merged = get((symbols[i], symbols[j]))[1]
        k = after[j]
        after[i] = k
        symbols[j] = -1
        # the pairs that begin at i, at j, and before i
        if k < n:
            before[k] = i
            got = get((merged, symbols[k]))
            changed = [(i, got[0] * n + i if got else _NONE), (j, _NONE)]
        else:
            changed = [(i, _NONE), (j, _NONE)] if j < n - 1 else [(i, _NONE)]
        h = before[i]
        if h >= 0:
            got = get((symbols[h], merged))
            changed.append((h, got[0] * n + h if got else _NONE))
        for at, low in changed:
            at += size
            if tree[at] == low:
                continue
            tree[at] = low
            while at > 1:
                other = tree[at ^ 1]
                if other < low:
                    low = other
                at >>= 1
                if tree[at] == low:
                    break
                tree[at] = low
    return [s for s in symbols if s >= 0]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class WordBpe(Merges):
    """Encoder and decoder of a vocabulary file: NFC, white space to one space, lower case, words by the
    file's own pattern, bytes as letters, merges with an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, ab = self.vocab.get(left), self.vocab.get(right), self.vocab.get(left + right)
            if a is not None and b is not None and ab is not None:
                self.pairs[a, b] = (rank, ab)
        self._index({a << WIDTH | b: rank for (a, b), (rank, _) in self.pairs.items()},
                    {a << WIDTH | b: ab for (a, b), (_, ab) in self.pairs.items()}, INSIDE)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name, later in (("L", _NOT_LETTERS), ("N", _NOT_NUMBERS)):
            less = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in later)
            split = split.replace(f"[\\p{{{name}}}]", f"\\p{{{name}}}").replace(
                f"\\p{{{name}}}", f"[\\p{{{name}}}--[{less}]]")
        self.words = regex.compile(split, regex.VERSION1).findall
        self.spaces = regex.compile(r"\s+").sub
        self.marks = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None
        letters = byte_letters()
        self.inner = [self.vocab.get(x) for x in letters]
        self.last = [self.vocab.get(x + self.suffix) for x in letters]
        self.lacking = None in self.inner + self.last
        if not self.lacking:
            self.symbols = np.array(self.inner + self.last, np.int32)
        self.forget()

    def forget(self) -> None:
        self.young: tuple[dict[str, bytes], dict[str, str]] = {}, {}  # ids and decoding of runs
        self.older: tuple[dict[str, bytes], dict[str, str]] = {}, {}

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw[:-1]]
        symbols.append(self.last[raw[-1]])
        if None in symbols:  # bytes that the vocabulary lacks
            symbols = [x for x in symbols if x is not None]
        return merge_word(symbols, self.pairs)

    def encode_words(self, words: list[str]) -> tuple[dict[str, bytes], dict[str, str]]:
        """Ids of each word, as little-endian 32-bit integers, and their decoding."""
        packed, plain = {}, {}
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        short = [] if self.lacking else [i for i, r in enumerate(raw) if len(r) <= SHORT_WORD]
        offsets = np.cumsum([0, *[len(raw[i]) for i in short]])
        for first, last in groups_of_rows(offsets, FLAT_BYTES):
            part = short[first:last]
            flat = np.frombuffer(b"".join([raw[i] for i in part]), np.uint8).astype(np.int64)
            at = offsets[first: last + 1] - offsets[first]
            flat[at[1:] - 1] += 256  # the last byte of a word
            ids, begin = self.merge(flat, at[:-1])
            every, names = ids.astype("<u4").tobytes(), list(map(self.names.__getitem__, ids.tolist()))
            begin = begin.tolist() + [len(names)]
            for i, a, b in zip(part, begin, begin[1:]):
                packed[words[i]] = every[4 * a: 4 * b]
                plain[words[i]] = " ".join(names[a:b])
        if len(short) < len(words):
            for word in words:
                if word not in packed:
                    ids = self.encode_word(word)
                    packed[word], plain[word] = np.array(ids, "<u4").tobytes(), self.decode(ids)
        return packed, plain

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids and the decoding of runs without white space."""
        cut = list(map(self.words, chunks))
        known, shown = self.encode_words(list(set().union(*cut)))
        packed, plain = self.young
        for chunk, words in zip(chunks, cut):
            if len(words) == 1:
                packed[chunk], plain[chunk] = known[words[0]], shown[words[0]]
            else:
                packed[chunk] = b"".join([known[w] for w in words])
                plain[chunk] = " ".join([shown[w] for w in words if shown[w]])

    def _plain(self, text: str) -> list[str]:
        """Runs without white space, as they are encoded."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if _SEPARATORS.search(text):  # str.split takes these for white space, the pattern does not
            return [_lower(x) for x in self.spaces(" ", text).split(" ") if x]
        return _lower(text).split()

    def _chunks(self, text: str) -> list[str]:
        """Runs of a text, and special tokens behind a space, which no run holds."""
        if not self.marks or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += self._plain(text[at: m.start()])
            out.append(" " + m[0])
            at = m.end()
        return out + self._plain(text[at:])

    def _recall(self, chunks: set[str]) -> None:
        """Fill the younger half of the memory with ``chunks``, from the older half or anew; it takes the older
        one's place when full."""
        new = chunks.difference(self.young[0])
        if len(self.young[0]) + len(new) > REMEMBERED_WORDS:
            self.older, self.young = self.young, ({}, {})
            new = chunks
        packed, plain = self.young
        for chunk in new.intersection(self.older[0]):
            packed[chunk], plain[chunk] = self.older[0][chunk], self.older[1][chunk]
        todo = []
        for chunk in new.difference(packed):
            if chunk[0] == " ":
                packed[chunk], plain[chunk] = np.array([self.special[chunk[1:]]], "<u4").tobytes(), chunk[1:]
            else:
                todo.append(chunk)
        self._learn(todo)

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids of each text, as little-endian 32-bit integers, and their decoding."""
        cut = list(map(self._chunks, texts))
        every = set().union(*cut)
        self._recall(every)
        packed, plain = self.young
        out = [(b"".join(map(packed.__getitem__, chunks)), " ".join(filter(None, map(plain.__getitem__, chunks))))
               for chunks in cut]
        if len(packed) > REMEMBERED_WORDS:  # of one slice alone
            self.forget()
        else:
            for chunk in every:
                if len(chunk) > REMEMBERED_LENGTH:
                    del packed[chunk], plain[chunk]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0][0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings of the ids, one space between them."""
        return " ".join(map(self.names.__getitem__, ids))


def _lower(text: str) -> str:
    """Lower case of each character by itself."""
    if text.isascii():
        return text.lower()
    if "Σ" in text:  # str.lower looks at a sigma's neighbours
        text = text.replace("Σ", "σ")
    if _LATER.search(text):
        text = text.translate(_LATER_LOWER)
    return text.lower()


_SEPARATORS = regex.compile("[\x1c-\x1f]")
_LATER = regex.compile("[" + "".join(map(chr, _LATER_LOWER)) + "]")


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = (), with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id_col, the columns of ``keep``, n_tokens, ids_sha256, decoded_sha256,
    and on demand ids (array of int) and decoded (string).

    ``path`` is a vocabulary file that every executor can open.  A missing text is an empty one and has
    no tokens.  Special tokens that stand in a text get their ids, as the public library does it.
    Repeated rows, missing ids and other columns pass as they are; an empty table gives none.

    One narrow pass.  A task holds the vocabulary, one slice of about 1 MB of texts and a bounded memory
    of words besides those of the slice; a very long text is a slice of its own, a very long word costs n log n.
    """
    fields = docs.select(id_col, *keep).schema
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields],
                        "n_tokens long, ids_sha256 string, decoded_sha256 string",
                        *["ids array<int>"] * with_ids, *["decoded string"] * with_text])

    def run(batches):
        bpe = load(path)
        bpe.forget()
        for batch in batches:
            _, offsets = text_buffer(batch.column(text_col))
            for a, b in groups_of_rows(offsets, 1 << 20):
                part = batch.slice(a, b - a)
                counts, idsums, textsums, every, decoded = [], [], [], [], []
                for ids, plain in bpe.encode_texts([t or "" for t in part.column(text_col).to_pylist()]):
                    counts.append(len(ids) // 4)
                    idsums.append(hashlib.sha256(ids).hexdigest())
                    textsums.append(hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        every.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    if with_text:
                        decoded.append(plain)
                columns = [part.column(f.name) for f in fields]
                columns += [pa.array(counts, pa.int64()), pa.array(idsums, pa.string()), pa.array(textsums, pa.string())]
                names = [*fields.names, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(every, pa.list_(pa.int32())))
                    names.append("ids")
                if with_text:
                    columns.append(pa.array(decoded, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.forget()  # the worker goes on with other work

    return docs.select(*dict.fromkeys([id_col, *keep, text_col])).mapInArrow(run, schema)
