"""Recurring passages of words, located by Aho-Corasick automata.

Phrases with content-defined ends confirm which passages recur (see ``repeats``).  The passages whose
windows the phrases alone do not settle are dealt to shards by phrase; each shard compiles an automaton of
its recurring windows, with one character per word, and streams its documents' passages through it to find
every occurrence.  The first occurrence of a window stays, all later ones go.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from themescope.llm.common import with_ids, with_row_key
from themescope.llm.hashing import Words
from themescope.llm.repeats import (
    WORDS, Unit, first_look, groups_by_key, hot_blocks, known, resolved, second_look, starts_batch,
)

_SCHEMA = "n_words long, n_removed long, kept_sha256 string, spans array<array<int>>"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))]
_NAMES = ["n_words", "n_removed", "kept_sha256", "spans"]


def _finish(raw: bytes, runs):
    words = raw.split()  # bytes.split parts at 0x20 and 0x09-0x0D, no others
    kept, at = [], 0
    for lo, hi in runs:
        kept += words[at:lo]
        at = hi
    kept = kept + words[at:] if at else words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [list(r) for r in runs]


def _segments(unit: Unit):
    window = unit.window

    def segment(raw, keys, lows, highs, hots):
        words, out = raw.split(), []
        for key, lo, hi, hot in zip(keys, lows, highs, hots):
            body, blocks = b" ".join(words[lo: hi + window]), None
            if hot:
                data = np.frombuffer(body, np.uint8)
                hashes = Words(data, np.array([0, len(data)]), "visible", lower=False).hash
                blocks = hot_blocks(hashes, hi - lo + 1, unit, lambda i, j: b" ".join(words[lo + i: lo + j]))
            out.append({"key": key, "lo": lo, "hi": hi, "hot": hot, "body": None if hot else body, "blocks": blocks})
        return out

    return segment


def _compare(window: int):
    def run(batches):
        for key, doc, lo, hi, bodies in groups_by_key(batches, 2000):
            letters: dict[bytes, str] = {}  # a character for each word of the block
            passages = []
            for body in bodies:
                for w in body.split(b" "):
                    if w not in letters:
                        n = len(letters) + 256
                        letters[w] = chr(n if n < 0xD800 else n + 0x800)
                passages.append("".join([letters[w] for w in body.split(b" ")]))
            seen: dict[str, bool] = {}  # whether it recurs
            automaton = ahocorasick.Automaton()
            patterns = 0
            for passage in passages:
                for i in range(len(passage) - window + 1):
                    piece = passage[i: i + window]
                    recurs = seen.get(piece)
                    seen[piece] = recurs is not None
                    if recurs is False:
                        automaton.add_word(piece, patterns)
                        patterns += 1
            if not patterns:
                continue
            automaton.make_automaton()
            first: list[tuple[int, int] | None] = [None] * patterns
            found: list[tuple[int, int, int]] = []
            for d, base, passage in zip(doc.tolist(), lo.tolist(), passages):
                for end, number in automaton.iter(passage):
                    at = (d, base + end - window + 1)
                    found.append((number, *at))
                    if first[number] is None or at < first[number]:
                        first[number] = at
            later = [(d, s) for number, d, s in found if (d, s) != first[number]]
            if later:
                rows = np.array(later, np.int64)
                yield starts_batch(rows[:, 0], rows[:, 1])

    return run


def remove_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Unit = WORDS) -> DataFrame:
    """One row per row of ``docs``: id_col, n_words, n_removed, kept_sha256, spans.

    A window is ``unit.window`` successive words (runs of anything but 0x20 and 0x09-0x0D) of a document.
    Words covered by a window that also starts earlier, in a document with a smaller id or before in the
    same, are removed; windows are judged on the input.  ``spans`` are the removed runs of words,
    [start, end).  A missing or wordless text keeps its nothing; of repeated rows, and rows that share an
    id, the one whose text sorts first counts as earlier, of equal ones any; a missing id is the smallest;
    extra columns are not looked at; an empty table gives none.
    """
    keyed = with_row_key(docs, id_col, text_col)
    marks = known(keyed[0], text_col, unit, first_stays=True)
    looked = first_look(keyed[0], marks, text_col, unit, _finish, _SCHEMA, _TYPES, _NAMES, _segments(unit))
    result = second_look(looked, resolved(looked, _compare(unit.window), True), unit, _finish, _SCHEMA, _TYPES, _NAMES)
    return with_ids(result, keyed, id_col).select(id_col, *_NAMES)


def report(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(id_col, *_NAMES[:-1])
