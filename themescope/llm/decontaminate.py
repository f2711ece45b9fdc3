"""Benchmark decontamination by winnowing.

Both sides keep the smallest ``k``-gram hash of every ``window`` of successive k-grams, so any shared
run of ``k + window - 1`` words shares a kept fingerprint.  Fingerprints of the benchmark are matched
against those of each document, and each hit is extended: all runs of words around the hit that could
hold it are compared with the item's own.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from themescope.llm.common import ROW_KEY, groups_of_rows, text_buffer, with_ids, with_row_key
from themescope.llm.hashing import Words, running, smallest_in_window, span

#: Words of a window, and of a fingerprint; 10 - 5 + 1 successive fingerprints make one window.
SPAN_WORDS, GRAM_WORDS = 10, 5
#: Bytes of benchmark text of which the prepared form is sent to all tasks at once.  A larger benchmark
#: is worked through in blocks of this size.
BLOCK_BYTES = 8_000_000


def winnowed(words: Words, first: int, last: int, n: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the n-grams kept among the words [first, last): the smallest of every
    ``keep`` successive ones."""
    grams = span(words.sums, *(np.arange(first, max(first, last - n + 1)) + d for d in (0, n)))
    if len(grams) < keep:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.unique(smallest_in_window(grams, keep)) if len(grams) < 1 << 22 else np.unique(np.concatenate(
        [smallest_in_window(grams[i: i + (1 << 21) + keep], keep) + i for i in range(0, len(grams) - keep + 1, 1 << 21)]))
    return at + first, grams[at]


class Index:
    """A block of benchmark items: fingerprints, and all windows by hash.

    An item of ``SPAN_WORDS`` words or more has its windows of that length, kept fingerprints of
    ``GRAM_WORDS`` words.  A shorter one is one window; its only fingerprint is the window itself.
    """

    def __init__(self, items: list[tuple[object, str]]):
        self.names = [str(i) for i, _ in items]
        data, offsets = text_buffer(pa.array([t for _, t in items], pa.string()))
        words = Words(data, offsets, "alnum", lower=True)
        words.sums = running(words.hash)
        prints: set[int] = set()
        self.windows: dict[int, dict[int, list[int]]] = defaultdict(dict)  # length: hash: items
        for i in range(len(items)):
            first, last = words.row[i], words.row[i + 1]
            length = min(SPAN_WORDS, last - first)
            if not length:
                continue
            if length == SPAN_WORDS:
                prints.update(winnowed(words, first, last, GRAM_WORDS, SPAN_WORDS - GRAM_WORDS + 1)[1].tolist())
            at = np.arange(first, last - length + 1)
            for h in set(span(words.sums, at, at + length).tolist()):
                self.windows[length].setdefault(h, []).append(i)
        self.prints = np.array(sorted(prints), np.uint64)
        self.hashes = {n: np.array(sorted(w), np.uint64) for n, w in self.windows.items()}

    def hits(self, words: Words, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the windows that occur among the words [first, last)."""
        starts, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, known in self.hashes.items():
            if n < SPAN_WORDS:
                at = np.arange(first, max(first, last - n + 1))
            else:  # extend the fingerprints that both sides kept
                places, prints = winnowed(words, first, last, GRAM_WORDS, SPAN_WORDS - GRAM_WORDS + 1)
                places = places[_among(prints, self.prints)]
                at = np.unique(places[:, None] - np.arange(SPAN_WORDS - GRAM_WORDS + 1))
                at = at[(at >= first) & (at + n <= last)]
            at = at[_among(span(words.sums, at, at + n), known)]
            starts.append(at)
            lengths.append(np.full(len(at), n))
        return np.concatenate(starts), np.concatenate(lengths)

    def items(self, words: Words, starts: np.ndarray, lengths: np.ndarray) -> list[str]:
        found = {(int(n), int(h)) for n, h in zip(lengths, span(words.sums, starts, starts + lengths))}
        return sorted({self.names[i] for n, h in found for i in self.windows[n][h]})


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _spans(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of covered words."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), (starts + lengths).tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


_SCAN = f"{ROW_KEY} long, n_words long, spans array<array<int>>, items array<string>"


def _scan(docs: DataFrame, text_col: str, index) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_col))
            keys = batch.column(ROW_KEY).to_pylist()
            for a, b in groups_of_rows(offsets, 1 << 21):
                at = offsets[a: b + 1]
                words = Words(data[at[0]: at[-1]], at - at[0], "alnum", lower=True)
                words.sums = running(words.hash)
                counts, spans, items = [], [], []
                for i in range(b - a):
                    first, last = int(words.row[i]), int(words.row[i + 1])
                    starts, lengths = index.value.hits(words, first, last)
                    counts.append(last - first)
                    spans.append(_spans(starts - first, lengths))
                    items.append(index.value.items(words, starts, lengths) if len(starts) else [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b], pa.int64()), pa.array(counts, pa.int64()),
                     pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int32()))),
                     pa.array(items, pa.list_(pa.string()))], names=[ROW_KEY, "n_words", "spans", "items"])

    return docs.select(ROW_KEY, text_col).mapInArrow(run, _SCAN)


def blocks_of(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, limit: int):
    """Indexes over consecutive items of at most ``limit`` bytes of text each (one item at least)."""
    held, size = [], 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        more = len((row[1] or "").encode("utf-8", "surrogatepass"))
        if held and size + more > limit:
            yield spark.sparkContext.broadcast(Index(held))
            held, size = [], 0
        held.append((row[0], row[1] or ""))
        size += more
    yield spark.sparkContext.broadcast(Index(held))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, spans (hit runs of words, [start, end)), items
    (sorted item ids as text).

    Words are runs of ASCII letters, digits and everything beyond ASCII, after lower-casing A-Z.  A
    missing or wordless text has no words and no hits; a missing or wordless item has no window;
    repeated items and ids, and a missing item id (its name is then ``None``), count once; repeated
    documents each get their row; an empty benchmark hits nothing.  Other columns are not looked at.

    Documents are read in one narrow pass for each block of the benchmark; only where there are several
    blocks do (small) rows of hits meet by document.
    """
    keyed = with_row_key(docs, id_col, text_col)
    found, several = None, False
    for index in blocks_of(docs.sparkSession, benchmark, item_col, item_text, block_bytes):
        part = _scan(keyed[0], text_col, index)
        found = part if found is None else found.unionByName(part)
        several = found is not part
    if several:
        found = found.groupBy(ROW_KEY).agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = found.withColumn("spans", _merged("spans"))
    return with_ids(found, keyed, id_col).select(id_col, "n_words", "spans", "items")


def _merged(spans: str):
    """Union of sorted runs, as an expression."""
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x[0] <= F.element_at(F.element_at(acc, -1), 2)),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(
            F.element_at(F.element_at(acc, -1), 1),
            F.greatest(F.element_at(F.element_at(acc, -1), 2), x[1]))))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<array<int>>)"), step)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`contamination`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]))
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"))
