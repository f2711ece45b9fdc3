"""Vectorised rolling hashes of bytes and words.

A sequence v0, v1, ... gets the running sum S[i] = v0 + v1 B + ... + v(i-1) B^(i-1) modulo 2^64.
The hash of any span is (S[end] - S[start]) * B^-start, mixed: equal spans have equal hashes wherever
they stand, and each span costs one subtraction and one product.  Single values are first spread over
64 bits by a mixing function, which breaks the regular structure that plain powers would keep.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_MASK = (1 << 64) - 1
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

PIECE = 1 << 20


def _table(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 1 << 20:  # a worker keeps 8 MB of each
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


#: A 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def running(values: np.ndarray) -> np.ndarray:
    """S of the module's formula, len + 1 values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _table("up", len(values)), out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end)."""
    return mix((sums[end] - sums[start]) * _table("down", len(sums))[start])


def second(sums_hash: np.ndarray, length) -> np.ndarray:
    """Fold a length or a second value into a hash."""
    return mix(sums_hash ^ (np.asarray(length).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, everything else unchanged."""
    upper = (data >= 65) & (data <= 90)
    return data | (upper.view(np.uint8) << 5)


def byte_class(kind: str) -> np.ndarray:
    """Which bytes belong to a word: ``alnum`` for 0-9, a-z and all above ASCII; ``visible`` for all
    but space and 0x09-0x0D."""
    table = np.zeros(256, bool)
    if kind == "alnum":
        table[48:58] = table[97:123] = table[128:] = True
    else:
        table[:] = True
        table[9:14] = table[32] = False
    return table


class Words:
    """Words of consecutive rows: byte starts and ends, hashes, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str, lower: bool, hashes: bool = True):
        """``data`` holds the rows' bytes, ``offsets`` where each begins; a word never crosses rows."""
        table = byte_class(kind)
        starts, ends, sums_at_start, sums_at_end, first = [], [], [], [], []
        breaks = offsets[1:-1]
        carry, open_word = np.uint64(0), False
        for at in range(0, len(data), PIECE):
            piece = data[at: at + PIECE]
            if lower:
                piece = lowered(piece)
            inside = table[piece]
            before = np.empty(len(piece), bool)
            before[0] = open_word
            before[1:] = inside[:-1]
            cut = breaks[np.searchsorted(breaks, at): np.searchsorted(breaks, at + len(piece))] - at
            begins = inside & ~before
            stops = before & ~inside
            held = cut[before[cut]]
            stops[held] = True
            begins[cut[inside[cut]]] = True
            open_word = bool(inside[-1])
            s, e = np.flatnonzero(begins), np.flatnonzero(stops)
            starts.append(s + at)
            ends.append(e + at)
            if hashes:
                sums = running(BYTE_VALUES[piece])
                up = np.uint64(pow(int(_BASE), at, 1 << 64))
                down = np.uint64(pow(int(_INVERSE), at, 1 << 64))
                sums = sums * up + carry
                carry = sums[-1]
                sums_at_start.append(sums[s])
                first.append(_table("down", PIECE)[s] * down)
                sums_at_end.append(sums[e])
        if open_word:
            ends.append(np.array([len(data)]))
            if hashes:
                sums_at_end.append(np.array([carry]))
        none, wide = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.start = np.concatenate([none, *starts])
        self.end = np.concatenate([none, *ends])
        if hashes:
            total = np.concatenate([wide, *sums_at_end]) - np.concatenate([wide, *sums_at_start])
            self.hash = mix(total * np.concatenate([wide, *first]))
        self.row = np.searchsorted(self.start, offsets)
        self.row[-1] = len(self.start)

    def grams(self, n: int) -> np.ndarray:
        """Hash of each run of ``n`` words, whatever row it ends in; len - n + 1 values, at least 0."""
        count = max(0, len(self.hash) - n + 1)
        sums = running(self.hash)
        at = np.arange(count)
        return span(sums, at, at + n)


def smallest_in_window(values: np.ndarray, k: int) -> np.ndarray:
    """For each i, where in [i, i + k) the smallest value stands (the first, if several).

    The lowest 22 bits of a value give way to its place, so at most 4 million values at once.
    """
    n = len(values)
    if n < k:
        return np.zeros(0, np.int64)
    bits = np.uint64((1 << 22) - 1)
    best = (values & ~bits) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= k:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < k:
        rest = k - width
        best = np.minimum(best[:-rest], best[rest:])
    return (best & bits).astype(np.int64)
