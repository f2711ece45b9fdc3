"""Windows that occur more than once, found through phrases with content-defined ends.

A rolling hash runs over a text.  In every window the place of its smallest value is the window's anchor,
so equal windows have equal anchors, and successive windows with one anchor form an *interval*.  Two names
(64-bit fingerprints) describe an interval: ``key``, the text from the anchor that all its windows share,
and ``ctx``, the whole text its windows span.

Equal windows have equal keys, so only keys that occur twice matter.  Intervals of equal ctx are equal
window by window and need no look at their text; only where one key has several contexts, at the edges of
repeated passages, are single windows compared, once for each distinct context.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from themescope.llm.common import ROW_KEY, groups_of_rows, stored, text_buffer
from themescope.llm.hashing import BYTE_VALUES, Words, running, second, smallest_in_window, span

#: A key with more contexts than this is hot: its windows are counted one by one with combining in each
#: task, as its contexts would not fit one task.
HOT_CONTEXTS = 500
_PIECE = 1 << 20
_ANCHORS = f"key long, ctx long, {ROW_KEY} long, lo int, hi int"
_FIELD = "4294967296BD"


class Unit(NamedTuple):
    """What windows are made of.

    ``window`` units, ``near`` places for the anchor, ``gram`` units under the rolling hash; the key spans
    the ``window - near + 1`` units from the anchor.
    """

    name: str
    window: int
    near: int
    gram: int

    @property
    def shared(self) -> int:
        return self.window - self.near + 1


BYTES = Unit("bytes", 200, 144, 16)
WORDS = Unit("words", 20, 14, 4)


def _intervals(values: np.ndarray, rows: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Key, ctx, row, first and last start of all intervals; ``rows`` are the offsets of the rows in
    ``values``, the hashed units."""
    sums = running(values)
    count = max(0, len(values) - unit.gram + 1)
    at = np.arange(count)
    grams = span(sums, at, at + unit.gram)
    lengths = np.maximum(np.diff(rows) - unit.window + 1, 0)
    row = np.repeat(np.arange(len(lengths)), lengths)
    start = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(rows[:-1], lengths)
    if not len(start):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    anchor = np.empty(len(start), np.int64)
    done = 0
    while done < len(start):
        base = start[done]
        end = int(np.searchsorted(start, base + _PIECE))
        best = smallest_in_window(grams[base: start[end - 1] + unit.near], unit.near)
        anchor[done:end] = best[start[done:end] - base] + base
        done = end
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, a = start[first], start[last], anchor[first]
    key = span(sums, a, a + unit.shared)
    ctx = second(span(sums, lo, hi + unit.window), (a - lo) * unit.near + (hi - lo))
    return key, ctx, row[first], lo - rows[row[first]], hi - rows[row[first]]


def _pieces(data: np.ndarray, offsets: np.ndarray, unit: Unit) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, start of the piece in its row, hashed units and their row offsets."""
    for a, b in groups_of_rows(offsets, _PIECE):
        at = offsets[a: b + 1]
        part = data[at[0]: at[-1]]
        if unit.name == "words":
            words = Words(part, at - at[0], "visible", lower=False)
            yield a, 0, words.hash, words.row
        elif len(part) <= 2 * _PIECE:
            yield a, 0, BYTE_VALUES[part], at - at[0]
        else:  # one long row, in overlapping pieces
            for s in range(0, len(part) - unit.window + 1, _PIECE):
                piece = part[s: s + _PIECE + unit.window - 1]
                yield a, s, BYTE_VALUES[piece], np.array([0, len(piece)])


def anchors(keyed: DataFrame, text_col: str, unit: Unit) -> DataFrame:
    """All intervals of all rows; one narrow pass."""
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_col))
            keys = batch.column(ROW_KEY).to_numpy()
            for a, skip, values, rows in _pieces(data, offsets, unit):
                key, ctx, row, lo, hi = _intervals(values, rows, unit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(keys[a + row]),
                     pa.array((lo + skip).astype(np.int32)), pa.array((hi + skip).astype(np.int32))],
                    names=["key", "ctx", ROW_KEY, "lo", "hi"])

    return keyed.select(ROW_KEY, text_col).mapInArrow(run, _ANCHORS)


def place(key: str, start: str):
    """(document, start) as one number that orders like the pair."""
    return (F.col(key).cast("decimal(20,0)") * F.expr(_FIELD) + F.col(start)).cast("decimal(38,0)")


def known(keyed: DataFrame, text_col: str, unit: Unit, first_stays: bool) -> DataFrame:
    """Per document with repeated windows: ``marks``, its intervals as (lo, hi, removed, open, key, hot).

    ``removed``: all windows of the interval go.  ``open``: the interval stands for its context, and its
    windows must be compared with those of the key's other contexts.  With ``first_stays`` the first
    interval of a context keeps its windows, else a window that occurs twice goes everywhere.
    """
    every = stored(anchors(keyed, text_col, unit), "anchors")
    twice = stored(every.groupBy("key").count().filter("count > 1").select("key"), "anchor-keys")
    shared = stored(every.join(twice, "key", "left_semi"), "anchors-shared")
    contexts = stored(shared.groupBy("key", "ctx").agg(
        F.count(F.lit(1)).alias("n"), F.min(place(ROW_KEY, "lo")).alias("first")), "contexts")
    mixed = stored(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("n_ctx")).filter("n_ctx > 1"), "mixed-keys")
    described = stored(contexts.join(mixed, "key", "left").filter("n > 1 OR n_ctx > 1"), "contexts-described")
    rows = shared.join(described, ["key", "ctx"])
    stands = F.col("first") == place(ROW_KEY, "lo")
    removed = ~stands if first_stays else F.col("n") > 1
    rows = rows.select(ROW_KEY, "lo", "hi", removed.alias("removed"), (stands & F.col("n_ctx").isNotNull()).alias("open"),
                       "key", (F.coalesce("n_ctx", F.lit(0)) > HOT_CONTEXTS).alias("hot"))
    return (rows.filter("removed OR open").groupBy(ROW_KEY)
            .agg(F.collect_list(F.struct("lo", "hi", "removed", "open", "key", "hot")).alias("marks")))


def runs_of(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Union of the half-open runs [lo, hi)."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    return list(zip(lo[new].tolist(), np.append(hi[new[1:] - 1], hi[-1]).tolist()))


Finish = Callable[[bytes, list[tuple[int, int]]], tuple]

#: Successive windows of a hot key that are named together; they are halved down to single ones.
BLOCK = 8


def _block_types(size: int) -> tuple[str, pa.DataType]:
    """A block and its halves, down to single windows: at, size, core, name, parts."""
    text, fields = "at:int,size:int,core:binary,name:binary", [
        ("at", pa.int32()), ("size", pa.int32()), ("core", pa.binary()), ("name", pa.binary())]
    if size > 1:
        inner, kind = _block_types(size // 2)
        text, fields = f"{text},parts:array<{inner}>", [*fields, ("parts", pa.list_(kind))]
    return f"struct<{text}>", pa.struct(fields)


_BLOCK, _BLOCK_TYPE = _block_types(BLOCK)
_SEGMENTS = f"segments array<struct<key:long,lo:int,hi:int,hot:boolean,body:binary,blocks:array<{_BLOCK}>>>"
_SEGMENT_TYPE = pa.list_(pa.struct([
    ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("hot", pa.bool_()), ("body", pa.binary()),
    ("blocks", pa.list_(_BLOCK_TYPE))]))


def hot_blocks(values: np.ndarray, count: int, unit: Unit, text) -> list[dict]:
    """The ``count`` windows of a hot interval in blocks that are aligned to its anchor, so that equal windows
    stand at equal places of their blocks; ``text(i, j)`` are the units from i to j.

    A block's *core* is the text that every window of its frame holds, from the frame's last start to its
    first end: windows that are equal stand in blocks with equal cores.
    """
    sums = running(values)
    at = np.arange(unit.near)
    anchor = int(smallest_in_window(span(sums, at, at + unit.gram), unit.near)[0])
    digest = lambda i, j, tail: hashlib.blake2b(text(i, j), digest_size=16).digest() + bytes(tail)

    def block(first: int, last: int) -> dict:
        """The frame of starts [first, last], of which the interval may lack some at its ends."""
        i, j = max(first, 0), min(last, count - 1)
        size = last - first + 1
        place = (anchor - last) % BLOCK
        name = digest(i, j + unit.window, (size, i - first, last - j, place))
        core = digest(last, first + unit.window, (size, place)) if size > 1 else name
        out = {"at": i, "size": j - i + 1, "core": core, "name": name}
        if size > 1:
            middle = first + size // 2
            halves = ((first, middle - 1), (middle, last))
            out["parts"] = [block(a, b) for a, b in halves if b >= 0 and a < count]
        return out

    last = anchor % BLOCK
    return [block(end - BLOCK + 1, end) for end in range(last, count + BLOCK - 1, BLOCK)]


def first_look(keyed: DataFrame, marks: DataFrame, text_col: str, unit: Unit, finish: Finish, schema: str,
               types: list[pa.DataType], names: list[str], segment) -> DataFrame:
    """Every document with its marks: finished where nothing is open, else its text, the runs that go
    already and the segments to compare.  The one shuffle of texts."""
    joined = keyed.select(ROW_KEY, text_col).join(marks, ROW_KEY, "left")

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(text_col))
            marks = batch.column("marks")
            keys = batch.column(ROW_KEY)
            for a, b in groups_of_rows(offsets, 4 * _PIECE):
                out = [[] for _ in types]
                texts, gone, segments = [], [], []
                for i in range(a, b):
                    raw = data[offsets[i]: offsets[i + 1]].tobytes()
                    runs, held = [], []
                    if marks[i].is_valid:
                        m = marks[i].values
                        lo, hi, cut, open_, key, hot = (m.field(j).to_numpy(zero_copy_only=False) for j in range(6))
                        runs = runs_of(lo[cut].astype(np.int64), hi[cut].astype(np.int64) + unit.window)
                        o = np.flatnonzero(open_)
                        if len(o):
                            held = segment(raw, key[o].tolist(), lo[o].tolist(), hi[o].tolist(), hot[o].tolist())
                    for column, value in zip(out, finish(raw, runs) if not held else (None,) * len(types)):
                        column.append(value)
                    texts.append(raw if held else None)
                    gone.append([list(r) for r in runs] if held else None)
                    segments.append(held or None)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), *[pa.array(c, t) for c, t in zip(out, types)], pa.array(texts, pa.binary()),
                     pa.array(gone, pa.list_(pa.list_(pa.int32()))), pa.array(segments, _SEGMENT_TYPE)],
                    names=[ROW_KEY, *names, "raw", "gone", "segments"])

    return stored(joined.mapInArrow(run, f"{ROW_KEY} long, {schema}, raw binary, gone array<array<int>>, {_SEGMENTS}"),
                  "repeats-looked-at")


def hot_windows(segments: DataFrame, first_stays: bool) -> DataFrame:
    """Runs of windows of hot keys that go, as (_k, lo, hi).

    Blocks whose core occurs once hold no window that recurs and are dropped.  Of the others whole blocks are
    compared; those without an equal, and one of each kind of equal ones, are halved and looked at in the
    same way, down to single windows.  So no row is made for a window whose surroundings are unique.  Equal
    names are combined in each task before they meet, and the tables of those that occur twice are stored
    before they are joined, so Spark can split a hot name.
    """
    def twice(rows: DataFrame, column: str, what: str) -> DataFrame:
        return stored(rows.groupBy(column).agg(
            F.count(F.lit(1)).alias("n"), F.min(place(ROW_KEY, "lo")).alias("first")).filter("n > 1").drop("n"), what)

    own = F.col("first") == place(ROW_KEY, "lo")
    rows = segments.filter("s.hot").select(ROW_KEY, F.col("s.lo").alias("base"), F.explode("s.blocks").alias("b"))
    gone, size = None, BLOCK
    while True:
        parts = ["b.parts"] if size > 1 else []
        rows = rows.select(ROW_KEY, "base", (F.col("base") + F.col("b.at")).alias("lo"),
                           (F.col("base") + F.col("b.at") + F.col("b.size") - 1).alias("hi"), "b.core", "b.name", *parts)
        if size > 1:
            rows = stored(rows.join(twice(rows, "core", "hot-cores").drop("first"), "core", "left_semi"), "hot-blocks")
        rows = rows.join(twice(rows, "name", "hot-names"), "name", "left" if size > 1 else "inner")
        if size > 1:
            rows = stored(rows, "hot-blocks-met")
        found = rows.filter(F.col("first").isNotNull() & (~own if first_stays else F.lit(True))).select(ROW_KEY, "lo", "hi")
        gone = found if gone is None else gone.unionByName(found)
        if size == 1:
            return gone
        rows = rows.filter(F.col("first").isNull() | own).select(ROW_KEY, "base", F.explode("parts").alias("b"))
        size //= 2


def resolved(looked: DataFrame, compare, first_stays: bool) -> DataFrame:
    """Runs of open windows that go, as lists per document of [first, last start].  Cold keys go to shards by key, hot ones
    window by window."""
    segments = looked.filter("segments IS NOT NULL").select(ROW_KEY, F.explode("segments").alias("s"))
    cold = (segments.filter("NOT s.hot").select(F.col("s.key").alias("key"), ROW_KEY, F.col("s.lo").alias("lo"),
                                                F.col("s.hi").alias("hi"), F.col("s.body").alias("body"))
            .repartition(F.col("key")).sortWithinPartitions("key"))
    shards = cold.mapInArrow(compare, f"{ROW_KEY} long, start int").select(
        ROW_KEY, F.col("start").alias("lo"), F.col("start").alias("hi"))
    return (shards.unionByName(hot_windows(segments, first_stays))
            .groupBy(ROW_KEY).agg(F.collect_list(F.array("lo", "hi")).alias("starts")))


def second_look(looked: DataFrame, starts: DataFrame, unit: Unit, finish: Finish, schema: str,
                types: list[pa.DataType], names: list[str]) -> DataFrame:
    """Finish the documents that had open windows; the others come as they are."""
    waiting = looked.filter("segments IS NOT NULL").select(ROW_KEY, "raw", "gone").join(starts, ROW_KEY, "left")

    def run(batches):
        for batch in batches:
            raw, gone, more = batch.column("raw"), batch.column("gone"), batch.column("starts")
            out = [[] for _ in types]
            for i in range(batch.num_rows):
                runs = np.array(gone[i].as_py(), np.int64).reshape(-1, 2)
                extra = np.array(more[i].as_py() or [], np.int64).reshape(-1, 2)
                lo, hi = np.append(runs[:, 0], extra[:, 0]), np.append(runs[:, 1], extra[:, 1] + unit.window)
                for column, value in zip(out, finish(raw[i].as_py(), runs_of(lo, hi))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(ROW_KEY), *[pa.array(c, t) for c, t in zip(out, types)]],
                                             names=[ROW_KEY, *names])

    late = waiting.mapInArrow(run, f"{ROW_KEY} long, {schema}")
    return looked.filter("segments IS NULL").select(ROW_KEY, *names).unionByName(late)


def groups_by_key(batches, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Rows of a partition sorted by key, in blocks of whole keys of at least ``limit`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0

    def columns(table: pa.Table):
        return (*(table.column(c).to_numpy() for c in ("key", ROW_KEY, "lo", "hi")), table.column("body").to_pylist())

    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            held.append(batch.slice(at, limit))
            size += held[-1].num_rows
            if size < 2 * limit:
                continue
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield columns(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            size = table.num_rows - cut
    if size:
        yield columns(pa.Table.from_batches(held))


def starts_batch(keys: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts.astype(np.int32))], names=[ROW_KEY, "start"])
