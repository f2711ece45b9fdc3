"""SentencePiece encoding and decoding by vectorised merge rounds over the new words of a slice of texts."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from themescope.llm.common import groups_of_rows, text_buffer
from themescope.llm.merges import INSIDE, WIDTH, Merges

SPACE = "▁"
#: Bytes of remembered words of a task, strings and their bookkeeping; then the memory starts anew.
REMEMBERED_BYTES = 80 << 20
_ENTRY_BYTES = 400
#: Code points merged at once.
FLAT_POINTS = 1 << 20


class PieceBpe(Merges):
    """A BPE model file with byte fallback and without text normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "ﬁ  ① "
        if model.decode(model.encode(probe)) != probe:
            raise ValueError(f"{path} normalises texts; only models that keep them as they are can be used")
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.shown = [p.replace(SPACE, " ") for p in self.names]
        self.decimal = list(map(str, range(n)))
        self.bytes_of = {i: int(self.names[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.byte_ids, self.is_byte = np.zeros(256, np.int64), np.zeros(n, bool)
        for i, b in self.bytes_of.items():
            self.byte_ids[b], self.is_byte[i] = i, True
        self.control = {i for i in range(n) if model.is_control(i)}
        self.unknown = {i for i in range(n) if model.is_unknown(i)}
        normal = {self.names[i]: i for i in range(n)
                  if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        order = sorted({-model.get_score(i) for i in normal.values()})
        place = {s: r for r, s in enumerate(order)}
        self.first = n  # symbols from here on: a code point without a piece
        self.symbols = np.arange(n, 0x110000 + n, dtype=np.int32)
        singles = [(ord(p), i) for p, i in normal.items() if len(p) == 1]
        points = np.array(singles, np.int64).reshape(-1, 2)
        self.symbols[points[:, 0]] = points[:, 1]
        pairs: dict[int, int] = {}
        merged: dict[int, int] = {}
        for piece, i in normal.items():
            size = len(piece)
            rank = place[-model.get_score(i)]
            for a, b, c in itertools.combinations(range(size + 1), 3):
                x, y = piece[a:b], piece[b:c]
                left = normal.get(x, ord(x) + n if len(x) == 1 else None)
                right = normal.get(y, ord(y) + n if len(y) == 1 else None)
                if left is None or right is None:
                    continue
                key = left << WIDTH | right
                if a == 0 and c == size:
                    pairs[key], merged[key] = rank, i
                else:
                    pairs.setdefault(key, int(INSIDE))
        self._index(pairs, merged)
        # Where a word may end before a space or around a line break, whatever stands there.
        inner = any(SPACE in p.lstrip(SPACE) for p in normal)
        breaks = any("\n" in p for p in normal)
        if inner:
            self.split = re.compile(r"(?s).+").findall
        else:
            self.split = re.compile(r" +[^ ]*" if breaks else r" *[^ \n]+| +|\n").findall
        self.clear()

    def clear(self) -> None:
        self.memory: dict[str, tuple[int, str, str]] = {}
        self.held = 0

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, one after another, and the len + 1 places where each begins.

        A word is a run of text as ``split`` gives it, spaces as spaces.
        """
        flat = "".join(words)
        points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        points[points == 32] = ord(SPACE)  # both mean a space
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        sym, begin = self.merge(points, starts)
        bare = np.flatnonzero(sym >= self.first)
        if len(bare):  # code points without a piece: the ids of their bytes
            raw = [np.frombuffer(chr(p).encode("utf-8", "surrogatepass"), np.uint8)
                   for p in (sym[bare] - self.first).tolist()]
            counts = np.ones(len(sym), np.int64)
            counts[bare] = [len(r) for r in raw]
            to = np.cumsum(counts) - counts
            out = np.repeat(sym, counts)
            spread = np.repeat(to[bare], counts[bare]) + np.concatenate([np.arange(len(r)) for r in raw])
            out[spread] = self.byte_ids[np.concatenate(raw)]
            sym, begin = out, np.append(to, len(out))[begin]
        return sym, np.append(begin, len(sym))

    def _text(self, ids: list[int]) -> str:
        """Pieces one after another; successive byte pieces are read as UTF-8, each bad byte as U+FFFD."""
        out = []
        for byte, group in itertools.groupby(ids, self.bytes_of.__contains__):
            if byte:
                out.append(_utf8(bytes([self.bytes_of[i] for i in group])))
            else:
                out += [" ⁇ " if i in self.unknown else "" if i in self.control else self.shown[i] for i in group]
        return "".join(out)

    def learn(self, words: set[str]) -> None:
        """Remember count, decimal ids and decoded text of each word."""
        todo = list(words)
        at = 0
        while at < len(todo):
            size, end = 0, at
            while end < len(todo) and (end == at or size + len(todo[end]) <= FLAT_POINTS):
                size += len(todo[end])
                end += 1
            part = todo[at:end]
            ids, bounds = self.encode_words(part)
            counts = np.diff(bounds)
            raw = np.flatnonzero(np.add.reduceat(self.is_byte[ids].astype(np.int64), bounds[:-1])).tolist()
            ids, bounds, counts = ids.tolist(), bounds.tolist(), counts.tolist()
            numbers, shown = list(map(self.decimal.__getitem__, ids)), list(map(self.shown.__getitem__, ids))
            spans = list(map(slice, bounds[:-1], bounds[1:]))
            lines = [",".join(numbers[x]) for x in spans]
            texts = ["".join(shown[x]) for x in spans]
            for i in raw:
                texts[i] = self._text(ids[spans[i]])
            self.memory.update(zip(part, zip(counts, lines, texts)))
            self.held += (_ENTRY_BYTES * len(part) + sum(map(len, lines))
                          + 4 * (sum(map(len, part)) + sum(map(len, texts))))
            at = end

    def encode_texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, decimal ids joined by commas, decoded text) of each text."""
        if self.held > REMEMBERED_BYTES:
            self.clear()
        parts = [self.split(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        self.learn(set().union(*parts).difference(self.memory))
        get = self.memory.__getitem__
        out = []
        for words in parts:
            if words:
                counts, lines, shown = zip(*map(get, words))
                out.append((sum(counts), ",".join(lines), "".join(shown)[1:]))
            else:
                out.append((0, "", ""))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.encode_texts([text])[0][1]
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: list[int]) -> str:
        """As the library's ``decode``: the space before the first piece is no part of the text."""
        shown = [i for i in ids if i not in self.control]
        if not shown:
            return ""
        text = self._text(shown)
        return text[1:] if self.names[shown[0]].startswith(SPACE) else text


def _utf8(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as error:
            out.append(raw[at: at + error.start].decode("utf-8"))
            out.append("�")
            at += error.start + 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                  keep: tuple[str, ...] = (), with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id_col, the columns of ``keep``, n_tokens, ids_sha256 (of decimal ids
    joined by commas), decoded_sha256, and on demand ids (array of int) and decoded (string).

    ``path`` is a model file that every executor can open.  A missing or empty text has no tokens and
    decodes to an empty one.  Strings of special pieces in a text are plain text.  Repeated rows, missing
    ids and other columns pass as they are; an empty table gives none.

    One narrow pass.  A task holds the model (about 30 MB), one slice of about 4 MB of texts and
    ``REMEMBERED_BYTES`` of words, which it forgets at its end; a very long text is a slice of its own.
    """
    fields = docs.select(id_col, *keep).schema
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields],
                        "n_tokens long, ids_sha256 string, decoded_sha256 string",
                        *["ids array<int>"] * with_ids, *["decoded string"] * with_text])

    def run(batches):
        bpe = load(path)
        bpe.clear()
        for batch in batches:
            _, offsets = text_buffer(batch.column(text_col))
            for a, b in groups_of_rows(offsets, 1 << 22):
                part = batch.slice(a, b - a)
                found = bpe.encode_texts([t or "" for t in part.column(text_col).to_pylist()])
                columns = [part.column(f.name) for f in fields]
                columns += [
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([hashlib.sha256(f[1].encode()).hexdigest() for f in found], pa.string()),
                    pa.array([hashlib.sha256(f[2].encode("utf-8", "surrogatepass")).hexdigest() for f in found],
                             pa.string()),
                ]
                names = [*fields.names, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    lists = [list(map(int, f[1].split(","))) if f[1] else [] for f in found]
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                if with_text:
                    columns.append(pa.array([f[2] for f in found], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        bpe.clear()

    return docs.select(*dict.fromkeys([id_col, *keep, text_col])).mapInArrow(run, schema)
