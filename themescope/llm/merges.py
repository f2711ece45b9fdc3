"""Byte-pair merges of many words at once, in rounds over one flat array of their symbols.

In each round every word finds its lowest-ranked adjacent pair by a segmented minimum, all words merge it at once,
leftmost first, and the array is compacted; words without a mergeable pair leave it.  A boundary that no longer
symbol spans can never be merged over, so a word falls apart there and its parts go on side by side; a very long
word does not hold up a round.
"""

from __future__ import annotations

import numpy as np

#: Rank of a pair that is no symbol itself but stands inside one, and of a boundary that no symbol spans.
INSIDE, CLOSED = np.int32(1 << 29), np.int32(1 << 30)
WIDTH = 21


class Merges:
    """A table of mergeable pairs; ``symbols`` holds the first symbol of each code point or byte."""

    symbols: np.ndarray

    def _index(self, pairs: dict[int, int], merged: dict[int, int], absent: np.int32 = CLOSED) -> None:
        """An open table of the pairs, at most a quarter full: slots are tried one after another.

        ``pairs`` and ``merged`` hold the rank of left << WIDTH | right and the symbol it becomes; ``absent`` is
        the rank of all other pairs, INSIDE where they may stand inside a longer symbol."""
        bits = max(8, (4 * len(pairs)).bit_length())
        self.shift, self.keys = np.uint64(64 - bits), np.full((1 << bits) + len(pairs), -1, np.int64)
        self.ranks = np.full(len(self.keys), absent, np.int32)
        self.merged = np.full(len(self.keys), -1, np.int32)
        todo = np.fromiter(pairs, np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        to = np.fromiter((merged.get(k, -1) for k in pairs), np.int64, len(pairs))
        slot = self._slots(todo)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == -1)
            taken, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[taken], self.ranks[taken], self.merged[taken] = todo[put], ranks[put], to[put]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, ranks, to, slot = todo[rest], ranks[rest], to[rest], slot[rest] + 1

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the symbol it becomes."""
        key = left.astype(np.int64) << WIDTH | right
        slot = self._slots(key)
        held = self.keys[slot]
        other = np.flatnonzero((held != key) & (held != -1))
        while len(other):
            slot[other] += 1
            held = self.keys[slot[other]]
            other = other[(held != key[other]) & (held != -1)]
        return self.ranks[slot], self.merged[slot]  # an empty slot holds an absent pair

    def merge(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of words given as indices into ``symbols`` one after another, and where each word begins.

        ``starts`` holds the first place of every word, none of them empty.
        """
        n = len(points)
        result = self.symbols[points]
        alive = np.ones(n, bool)  # places of ``result`` that still begin a symbol
        sym, at = result.copy(), np.arange(n)
        rank = np.full(n, CLOSED, np.int32)  # of the pair that a symbol forms with the next one
        target = np.full(n, -1, np.int32)
        if n > 1:
            rank[:-1], target[:-1] = self._look(sym[:-1], sym[1:])
        rank[starts[1:] - 1] = CLOSED
        while True:
            # Parts between closed boundaries; those without a mergeable pair are finished.
            last = rank == CLOSED
            begins = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(sym) else np.zeros(0, np.int64)
            if not len(begins):
                break
            low = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(sym)))
            keep = low < INSIDE
            if not keep.any():
                break
            if not keep.all():
                stay = np.repeat(keep, sizes)
                sym, at, rank, target = sym[stay], at[stay], rank[stay], target[stay]
                low, sizes = low[keep], sizes[keep]
                begins = np.cumsum(sizes) - sizes
            part = np.repeat(np.arange(len(sizes)), sizes)
            # Every occurrence of the lowest rank; of a run of overlapping ones the first, third, ...
            where = np.flatnonzero(rank == low[part])
            head = np.ones(len(where), bool)
            head[1:] = where[1:] != where[:-1] + 1
            run_start = np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run_start) % 2 == 0]
            # A merge may make a pair that comes first in turn; then the part stops there in this round.
            new = target[where]
            floor, owner = rank[where], part[where]
            left_at, right_at = where - 1, where + 2
            touching = np.zeros(len(where), bool)
            touching[1:] = where[1:] == where[:-1] + 2
            has_left = (where > begins[owner])
            left = sym[np.maximum(left_at, 0)]
            left[touching] = new[:-1][touching[1:]]
            ends = begins + sizes
            has_right = right_at < ends[owner]
            right = sym[np.minimum(right_at, len(sym) - 1)]
            worse = (has_left & (self._look(left, new)[0] <= floor)) | (has_right & (self._look(new, right)[0] <= floor))
            if worse.any():
                seen = np.cumsum(worse) - worse
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                lengths = np.diff(np.append(first, len(where)))
                go = seen == np.repeat(seen[first], lengths)
                where, new = where[go], new[go]
            # Merge, drop the right halves, and look up the pairs beside the new symbols.
            sym[where] = new
            result[at[where]] = new
            rank[where] = rank[where + 1]  # whether the part ends behind the new symbol
            dropped = np.ones(len(sym), bool)
            dropped[where + 1] = False
            alive[at[where + 1]] = False
            now = (np.cumsum(dropped) - 1)[where]
            sym, at, rank, target = sym[dropped], at[dropped], rank[dropped], target[dropped]
            touched = np.concatenate([now, now - 1])
            touched = touched[touched >= 0]
            touched = touched[rank[touched] != CLOSED]
            rank[touched], target[touched] = self._look(sym[touched], sym[touched + 1])
        places = np.flatnonzero(alive)
        return result[places], np.searchsorted(places, starts)
