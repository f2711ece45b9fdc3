"""Repeated substrings by prefix-free parsing.

A rolling hash puts phrase ends where it is smallest, so equal stretches are parsed alike wherever they
stand.  The parse is kept by names: two places of the parse whose names agree continue alike, which orders
the corpus as far as a window needs (equal continuations stand together; which of two different ones comes
first does not matter here).  The dictionary holds each distinct phrase context once.  Where the parse alone
does not settle a window, the suffixes of the dictionary entries concerned are sorted, byte by byte, and
neighbours with a common prefix of a whole window are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themescope.llm.common import with_ids, with_row_key
from themescope.llm.hashing import BYTE_VALUES
from themescope.llm.repeats import (
    BYTES, Unit, first_look, groups_by_key, hot_blocks, known, resolved, second_look, starts_batch,
)

_SCHEMA = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
_NAMES = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]


def _finish(raw: bytes, runs):
    digest, at, view = hashlib.sha256(), 0, memoryview(raw)
    for lo, hi in runs:
        digest.update(view[at:lo])
        at = hi
    digest.update(view[at:])
    return len(raw), sum(hi - lo for lo, hi in runs), len(runs), digest.hexdigest(), [list(r) for r in runs]


def _segments(unit: Unit):
    window = unit.window

    def segment(raw, keys, lows, highs, hots):
        out = []
        for key, lo, hi, hot in zip(keys, lows, highs, hots):
            body = raw[lo: hi + window]
            blocks = hot_blocks(BYTE_VALUES[np.frombuffer(body, np.uint8)], hi - lo + 1, unit,
                                lambda i, j: body[i: j]) if hot else None
            out.append({"key": key, "lo": lo, "hi": hi, "hot": hot, "body": None if hot else body, "blocks": blocks})
        return out

    return segment


def _compare(window: int):
    """Suffix array of dictionary entries, key by key, to the depth of a window."""
    def run(batches):
        for key, doc, lo, hi, bodies in groups_by_key(batches, 200):
            counts = hi - lo + 1
            entry = np.repeat(np.arange(len(key)), counts)
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            joined = np.frombuffer(b"".join(bodies), np.uint8)
            sizes = np.array([len(b) for b in bodies])
            begin = (np.cumsum(sizes) - sizes)[entry] + offset
            suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(joined, window)[begin])
            named = np.empty((len(entry), window + 8), np.uint8)
            named[:, :8] = key[entry].astype(">i8").view(np.uint8).reshape(-1, 8)
            named[:, 8:] = suffixes
            order = np.argsort(named.view(f"V{window + 8}").ravel(), kind="stable")
            same = np.all(named[order[1:]] == named[order[:-1]], axis=1)
            repeated = np.zeros(len(entry), bool)
            repeated[order[1:][same]] = True
            repeated[order[:-1][same]] = True
            at = entry[repeated]
            yield starts_batch(doc[at], lo[at] + offset[repeated])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Unit = BYTES) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Every byte covered by a string of ``unit.window`` bytes that starts at least twice, in one document or
    in several, is removed; strings are judged on the input.  ``spans`` are the maximal removed runs of
    bytes, [start, end).  A missing text is empty; texts shorter than a window lose nothing; of repeated
    rows each is a document of its own, so all long enough lose everything; missing ids are allowed; extra
    columns are not looked at; an empty table gives none.
    """
    keyed = with_row_key(docs, id_col, text_col)
    marks = known(keyed[0], text_col, unit, first_stays=False)
    looked = first_look(keyed[0], marks, text_col, unit, _finish, _SCHEMA, _TYPES, _NAMES, _segments(unit))
    result = second_look(looked, resolved(looked, _compare(unit.window), False), unit, _finish, _SCHEMA, _TYPES, _NAMES)
    return with_ids(result, keyed, id_col).select(id_col, *_NAMES)


def report(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, *_NAMES[:-1])


def cut(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed bytes taken out of the text (ids must be unique)."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    joined = docs.join(removed.select(id_col, "spans"), id_col)
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s[1]))
    begins = F.concat(F.transform("spans", lambda s: s[0]), F.array(F.length(body)))
    kept = F.zip_with(ends, begins, lambda a, b: F.substring(body, a + 1, b - a).cast("string"))
    return joined.withColumn(text_col, F.array_join(kept, "")).drop("spans")
