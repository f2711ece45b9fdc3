"""Alignment of two tokenizers over a corpus, with inverted bitmaps per pair of ids.

A token of the one and a token of the other tokenizer are linked where their bytes overlap.  Every pair of
linked ids has postings: per block of documents a compressed bitmap of those that hold the pair, and bit planes
of how often they hold it.  The bitmaps' bits, counted over all blocks, are the pair's document count.  The
counts go back along the same postings: plane by plane they are added up into the documents' scores.

A *chunk* is a stretch of text at whose ends both tokenizers end a token, whatever stands around it; each
distinct chunk is encoded and aligned once.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from themescope.llm import piece_bpe
from themescope.llm.bpe import byte_letters
from themescope.llm.common import groups_of_rows, stored, text_buffer

#: (document, pair) entries and documents after which a block of postings is closed.
BLOCK_ENTRIES, BLOCK_DOCS = 1 << 20, 1 << 16
#: Bytes of remembered chunks of a task; then the memory starts anew.
REMEMBERED_BYTES = 80 << 20
_ENTRY_BYTES = 300
#: Bytes of text aligned at once; a longer text stands alone.
SLICE_BYTES = 1 << 20
#: Chunks whose encodings, as the library gives them, are held at once.
ENCODED_AT_ONCE = 4096
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")

# Texts whose white space is single spaces and line breaks between words: every space begins a chunk, and so
# does every line break and what follows it.  Others begin chunks at single spaces between words only.
_UNUSUAL = re.compile(r"[^\S \n]|  | \n|\n |^[ \n]|[ \n]\Z").search
_USUAL_CHUNKS = re.compile(r" ?[^ \n]+|\n+(?=\n)|\n").findall
_OTHER_CHUNKS = re.compile(r"(?<=\S)(?= \S)").split


class Aligner:
    """Two vocabularies, the bytes of their tokens, and the chunks a task has seen."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = piece_bpe.PieceBpe(path_b)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        size = max(self.a.get_vocab().values()) + 1
        names_a = [self.a.id_to_token(i) or "" for i in range(size)]
        special = set(self.a.get_added_tokens_decoder())
        self._bytes_a = _Bytes([b"" if i in special else bytes(map(byte_of.__getitem__, t))
                                for i, t in enumerate(names_a)])
        self._bytes_b = _Bytes([bytes([self.b.bytes_of[i]]) if i in self.b.bytes_of else t.encode()
                                for i, t in enumerate(self.b.shown)])
        na, nb = len(names_a), len(self.b.names)
        self.bits_b = nb.bit_length()  # a pair of ids is one number
        # Decimal ids with what follows them: A within a group, A at its end, B within it, B at its end.
        self._shown = [f"{i}{end}" for n, end in ((na, ","), (na, "|"), (nb, ","), (nb, ";")) for i in range(n)]
        self._variant = np.cumsum([0, na, na, nb])
        self.plain = not any("\n" in p or piece_bpe.SPACE in p.lstrip(piece_bpe.SPACE) for p in self.b.names)
        self.clear()

    def clear(self) -> None:
        self.memory: dict[str, int] = {}
        self.lines: list[str] = []
        self.numbers = np.zeros((0, len(_NUMBERS)), np.int64)
        self.fits = np.zeros(0, bool)
        self.pairs, self.pair_bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        """``text`` behind a space, cut where both tokenizers end a token."""
        if not self.plain:
            return [" " + text]
        return _OTHER_CHUNKS(" " + text) if _UNUSUAL(text) else _USUAL_CHUNKS(" " + text)

    def learn(self, chunks: list[str]) -> None:
        """Encode and align new chunks, all at once."""
        if not chunks:
            return
        # A space before the text comes from the chunk itself, so B's own prefix is not added.
        ids_b, bound_b = self.b.encode_words(chunks)
        encoded = []
        for at in range(0, len(chunks), ENCODED_AT_ONCE):
            encoded += [e.ids for e in self.a.encode_batch_fast(chunks[at: at + ENCODED_AT_ONCE],
                                                                add_special_tokens=False)]
        size_a = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids_a = np.fromiter(chain.from_iterable(encoded), np.int64, int(size_a.sum()))
        size_b = np.diff(bound_b)
        raw = [c.encode("utf-8", "surrogatepass") for c in chunks]
        n_bytes = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.frombuffer(b"".join(raw), np.uint8)
        fits = self._bytes_a.spell(ids_a, size_a, whole, n_bytes) & self._bytes_b.spell(ids_b, size_b, whole, n_bytes)
        if not fits.all():
            ids_a, ids_b = ids_a[np.repeat(fits, size_a)], ids_b[np.repeat(fits, size_b)]
            size_a, size_b, n_bytes = size_a * fits, size_b * fits, n_bytes * fits
        end_a, end_b = np.cumsum(self._bytes_a.sizes[ids_a]), np.cumsum(self._bytes_b.sizes[ids_b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        parts = np.union1d(end_a, end_b)  # between two of these one token of each side overlaps
        pairs = ids_a[np.searchsorted(end_a, parts)] << self.bits_b | ids_b[np.searchsorted(end_b, parts)]
        ends = np.cumsum(n_bytes)
        groups = np.diff(np.searchsorted(cuts, ends, "right"), prepend=0)
        links = np.diff(np.searchsorted(parts, ends, "right"), prepend=0)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        last_a, last_b = np.isin(end_a, cuts, assume_unique=True), np.isin(end_b, cuts, assume_unique=True)
        code = np.concatenate([ids_a + self._variant[last_a.astype(np.int64)],
                               ids_b + self._variant[2 + last_b.astype(np.int64)]])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        shown = list(map(self._shown.__getitem__, code[order].tolist()))
        upto = np.cumsum(size_a + size_b).tolist()
        lines = ["".join(shown[a:b]) for a, b in zip([0, *upto], upto)]
        self.memory.update(zip(chunks, range(len(self.lines), len(self.lines) + len(chunks))))
        self.lines += lines
        self.numbers = np.concatenate([self.numbers, np.stack([size_a, size_b, groups, links], 1)])
        self.fits = np.concatenate([self.fits, fits])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.pair_bounds = np.concatenate([self.pair_bounds, self.pair_bounds[-1] + np.cumsum(links)])
        self.held += _ENTRY_BYTES * len(chunks) + int(n_bytes.sum()) + sum(map(len, lines)) + 8 * len(pairs)

    def align(self, texts: list[str]):
        """Per text the four numbers and the line of its groups; then pairs in order of (a, b), the text each
        is in, and how often it is linked there."""
        if self.held > REMEMBERED_BYTES:
            self.clear()
        cut = [self.chunks(t) if t else [] for t in texts]
        self.learn(list(set().union(*cut).difference(self.memory)))
        get = self.memory.__getitem__
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(texts)), counts)
        bad = np.zeros(len(texts), bool)
        bad[owner[~self.fits[flat]]] = True
        if bad.any():  # joined bytes differ from space and text: no tokens
            keep = ~bad[owner]
            flat, owner = flat[keep], owner[keep]
            counts = np.where(bad, 0, counts)
        numbers = np.zeros((len(texts), len(_NUMBERS)), np.int64)
        np.add.at(numbers, owner, self.numbers[flat])
        lines, at, of = [], 0, flat.tolist()
        for n in counts.tolist():
            lines.append("".join([self.lines[i] for i in of[at: at + n]])[:-1])
            at += n
        first, size = self.pair_bounds[flat], np.diff(self.pair_bounds)[flat]
        places = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
        bits = np.int64(len(texts).bit_length())
        key = self.pairs[places] << bits | np.repeat(owner, size)
        key.sort()
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(key)))
        key = key[head]
        return numbers, lines, key >> bits, key & ((1 << bits) - 1), times

    def ids(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pairs >> self.bits_b, pairs & ((1 << self.bits_b) - 1)


class _Bytes:
    """Bytes of each token of a vocabulary in one array."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray, counts: np.ndarray, whole: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """Whether the tokens of each chunk, ``counts`` of ``ids``, spell its ``n_bytes`` of ``whole``."""
        size = self.sizes[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.concatenate([[0], np.cumsum(counts)])
        got = upto[at[1:]] - upto[at[:-1]]
        right = got == n_bytes
        if not right.all():  # lengths differ: compare the others only
            ids, whole = ids[np.repeat(right, counts)], whole[np.repeat(right, n_bytes)]
            size = self.sizes[ids]
        source = np.arange(int(size.sum())) + np.repeat(self.starts[ids] - (np.cumsum(size) - size), size)
        wrong = np.flatnonzero(self.data[source] != whole)
        if len(wrong):
            among = np.flatnonzero(right)
            right[among[np.searchsorted(np.cumsum(n_bytes[right]), wrong, "right")]] = False
        return right


@functools.lru_cache(maxsize=1)
def load(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def postings(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, n_docs: int) -> pa.RecordBatch:
    """Compressed bitmaps of one block, one row per pair and plane, from (pair, doc) in order.

    Plane 0 holds the documents with the pair, plane j + 1 those where bit j of (times - 1) is set.  A bitmap is
    a sorted list of 16-bit numbers, or plain bits where these are shorter.
    """
    rows = [(0, np.ones(len(pair), bool))]
    more = times - 1
    for j in range(int(more.max(initial=0)).bit_length()):
        rows.append((j + 1, (more >> j) & 1 == 1))
    width = (n_docs + 7) // 8
    out = []
    for plane, held in rows:
        p, d = pair[held], doc[held]
        head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(p)))
        dense = 2 * size > width
        listed = np.repeat(~dense, size)
        numbers = d[listed].astype("<u2")
        upto = np.cumsum(2 * size[~dense])
        out.append((p[head][~dense], plane, False, pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(upto),
            [None, pa.py_buffer(np.concatenate([[0], upto]).astype(np.int64)), pa.py_buffer(numbers.tobytes())])))
        if dense.any():
            bits = np.zeros((int(dense.sum()), 8 * width), bool)
            bits[np.repeat(np.arange(len(bits)), size[dense]), d[~listed]] = True
            packed = np.packbits(bits, axis=1)
            out.append((p[head][dense], plane, True, pa.array([r.tobytes() for r in packed], pa.large_binary())))
    pairs = np.concatenate([o[0] for o in out])
    return pa.RecordBatch.from_arrays(
        [pa.array(pairs, pa.int64()),
         pa.array(np.repeat([o[1] for o in out], [len(o[0]) for o in out]), pa.int32()),
         pa.array(np.repeat([o[2] for o in out], [len(o[0]) for o in out]), pa.bool_()),
         pa.concat_arrays([o[3] for o in out]).cast(pa.binary())], names=["pair", "plane", "dense", "bits"])


def add_up(n_docs: int, planes, dense, bits: list[bytes], values) -> np.ndarray:
    """Sum over the given bitmaps of weight of plane * value, for each document of a block."""
    out = np.zeros(n_docs, np.int64)
    weight = np.where(planes == 0, 1, 1 << np.maximum(planes - 1, 0)) * values
    listed = np.flatnonzero(~dense)
    numbers = np.frombuffer(b"".join([bits[i] for i in listed.tolist()]), "<u2")
    size = np.fromiter((len(bits[i]) // 2 for i in listed.tolist()), np.int64, len(listed))
    np.add.at(out, numbers, np.repeat(weight[listed], size))
    for i in np.flatnonzero(dense).tolist():
        held = np.unpackbits(np.frombuffer(bits[i], np.uint8), count=n_docs)
        out[np.flatnonzero(held)] += weight[i]
    return out


def indexed(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Documents (``place`` in their block, id, numbers, digest and text of groups) and postings, in one table.

    A block belongs to one task, so its number is unique and its documents stand together.
    """
    kind = docs.schema[id_col].dataType
    fields = [("block", "long"), ("place", "int"), ("id", kind.simpleString()), *[(n, "long") for n in _NUMBERS],
              ("groups_sha256", "string"), ("a", "int"), ("b", "int"), ("plane", "int"), ("dense", "boolean"),
              ("bits", "binary")]
    schema = ", ".join(f"{n} {t}" for n, t in fields)

    def table(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
                 "binary": pa.binary()}
        return pa.RecordBatch.from_arrays(
            [columns[c] if c in columns else pa.nulls(n, types.get(t) or id_type) for c, t in fields],
            names=[c for c, _ in fields])

    id_type = pa.int64()

    def run(batches):
        nonlocal id_type
        aligner = load(path_a, path_b)
        aligner.clear()
        block, place, entries, held = TaskContext.get().partitionId() << 24, 0, 0, []

        def closed():
            pair, doc, times = (np.concatenate([h.pop(0) for h in held]) for _ in range(3))
            order = np.argsort(pair, kind="stable")  # slices come in order of their documents
            found = postings(pair[order], doc[order], times[order], place)
            a, b = aligner.ids(found.column("pair").to_numpy())
            return table(block=pa.array(np.full(len(found), block), pa.int64()), a=pa.array(a, pa.int32()),
                         b=pa.array(b, pa.int32()), **{n: found.column(n) for n in ("plane", "dense", "bits")})

        for batch in batches:
            id_type = batch.column("id").type
            _, offsets = text_buffer(batch.column("text"))
            for a, b in groups_of_rows(offsets, SLICE_BYTES):
                for a in range(a, b, BLOCK_DOCS):
                    part = batch.slice(a, min(b - a, BLOCK_DOCS))
                    if held and (entries >= BLOCK_ENTRIES or place + len(part) > BLOCK_DOCS):
                        yield closed()
                        block, place, entries, held = block + 1, 0, 0, []
                    numbers, lines, pair, doc, times = aligner.align(
                        [t or "" for t in part.column("text").to_pylist()])
                    held.append([pair, (doc + place).astype(np.int32), times.astype(np.int32)])
                    entries += len(pair)
                    digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in lines]
                    yield table(block=pa.array(np.full(len(part), block), pa.int64()),
                                place=pa.array(np.arange(place, place + len(part)), pa.int32()), id=part.column("id"),
                                **{n: pa.array(numbers[:, i], pa.int64()) for i, n in enumerate(_NUMBERS)},
                                groups_sha256=pa.array(digests, pa.string()))
                    place += len(part)
        if held:
            yield closed()
        aligner.clear()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """Per pair of ids (a, b): ``n`` documents that hold it linked, ``best``: no pair of a is in more."""
    popcount = F.when(F.col("dense"), F.bitmap_count("bits")).otherwise(F.octet_length("bits") / 2).cast("long")
    counts = found.filter("plane = 0").groupBy("a", "b").agg(F.sum(popcount).alias("n"))
    # As many rows per a as tokenizer B has ids, at most.
    return counts.withColumn("best", (F.col("n") == F.max("n").over(W.partitionBy("a"))).cast("long"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` is a byte-level BPE file, ``path_b`` a SentencePiece BPE file, which every executor can open.  A
    text stands behind one space; special tokens' strings in it are plain text.  Missing and empty texts, and
    those whose tokens' bytes differ from the text's (a U+2581 in it), have no tokens: zeros and ''.  Repeated
    rows and missing ids are documents of their own, other columns are ignored, an empty table gives none.

    Texts are encoded in one narrow pass, which stores the postings.  These are shuffled twice, by pair and by
    block of documents; a frequent pair has one short row per block.  A task holds one slice of 1 MB of texts
    (or one longer text), REMEMBERED_BYTES of chunks and one block of BLOCK_ENTRIES postings.
    """
    kind = docs.schema[id_col].dataType
    found = stored(indexed(docs, path_a, path_b, id_col, text_col), "alignment")
    counted = (found.filter("plane IS NOT NULL").select("block", "a", "b", "plane", "dense", "bits")
               .join(pair_counts(found), ["a", "b"]).drop("a", "b"))
    rows = found.filter("plane IS NULL").select("block", "place", "id", *_NUMBERS, "groups_sha256")
    names = [id_col, *_NUMBERS, "n_best", "count_sum", "groups_sha256"]
    schema = ", ".join([f"`{id_col}` {kind.simpleString()}", *[f"{n} long" for n in names[1:-1]], "groups_sha256 string"])

    def scored(block: pa.Table) -> pa.Table:
        is_doc = block.column("plane").is_null()
        docs_of = block.filter(is_doc).sort_by("place")
        held = block.filter(block.column("plane").is_valid())
        planes = held.column("plane").to_numpy()
        dense, bits = held.column("dense").to_numpy(zero_copy_only=False).astype(bool), held.column("bits").to_pylist()
        n, best = held.column("n").to_numpy(), held.column("best").to_numpy()
        return pa.table([docs_of.column("id"), *[docs_of.column(c) for c in _NUMBERS],
                         pa.array(add_up(len(docs_of), planes, dense, bits, best), pa.int64()),
                         pa.array(add_up(len(docs_of), planes, dense, bits, n), pa.int64()),
                         docs_of.column("groups_sha256")], names=names)

    return rows.unionByName(counted, allowMissingColumns=True).groupBy("block").applyInArrow(scored, schema)
