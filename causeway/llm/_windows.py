"""Hashes of fixed-length windows of words or bytes, and the choice of one anchor per window.

Every window of L units holds L - k + 1 grams of k units; the gram with the smallest hash
(the leftmost, if several are equal) is the window's anchor. Equal windows have equal anchors
at equal offsets, so windows can be compared per anchor, and a text of n units has only about
2n / (L - k + 2) anchors. This chooses without loss: a window is repeated only if its anchor is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Positions handled at once: bounds the memory for texts of any length, and fits a processor's cache.
CHUNK = 1 << 17
LOW = np.uint64((1 << 24) - 1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=4)
def _random(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64)


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def grams(units: np.ndarray, length: int, seed: int = 7) -> np.ndarray:
    """Hash of the `length` units from each position, by doubling: the hash of 2m units
    combines the hashes of two runs of m units."""
    n = len(units)
    if n < length:
        return np.zeros(0, np.uint64)
    multipliers = _random(seed, 64) | np.uint64(1)
    have, at, out, done, level = units, 1, None, 0, 0
    while at <= length:
        if length & at:
            if out is None:
                out, done = have, at
            else:
                size = n - done - at + 1
                out = out[:size] * multipliers[32 + level] + have[done : done + size]
                done += at
        if 2 * at <= length:
            size = n - 2 * at + 1
            have = have[:size] * multipliers[level] + have[at : at + size]
        at, level = 2 * at, level + 1
    return scramble(out[: n - length + 1])


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    both = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


class Spans:
    """Hashes of any runs of units, from prefix sums of their polynomial."""

    def __init__(self, values: np.ndarray, block: int):
        self.up, self.down = _powers(max(block, 1 << int(len(values)).bit_length()))
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return scramble((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words of all texts, and the n + 1 offsets of the texts in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, block: int = CHUNK) -> np.ndarray:
    """64-bit hash of each word's bytes (lower: with A-Z as a-z), from prefix sums, a block of words at a time."""
    out = np.empty(len(starts), np.uint64)
    table = _random(11, 256)
    if lower:
        table = table.copy()
        table[65:91] = table[97:123]
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + block, "right")))
        out[at:to] = Spans(table[data[base : ends[to - 1]]], block)(starts[at:to] - base, ends[at:to] - base)
        at = to
    return out


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if width > span else v


def pieces(bounds: np.ndarray, overlap: int, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first unit, first text, bounds within) of runs of texts; a longer text comes in overlapping parts."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + chunk, "right")) - 1
        if j > i:
            yield int(bounds[i]), i, bounds[i : j + 1] - bounds[i]
            i = j
            continue
        at, end = int(bounds[i]), int(bounds[i + 1])
        while True:
            to = min(end, at + chunk)
            yield at, i, np.array([0, to - at])
            if to == end:
                break
            at = to - overlap
        i += 1


def anchors(hashes: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a piece: anchor positions with the first and last window start that each stands for, and the text's index.
    hashes: of the k units from each position; bounds: of the texts within the piece."""
    n = int(bounds[-1])
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none
    v = (hashes[: n - k + 1] & ~LOW) | np.arange(n - k + 1, dtype=np.uint64)
    least = (_sliding_min(v, window - k + 1) & LOW).astype(np.int64)
    starts = np.arange(n - window + 1)
    ok = starts + window <= np.repeat(bounds[1:], np.diff(bounds))[: n - window + 1]
    starts = starts[ok]
    if not len(starts):
        return none, none, none, none
    at = least[ok]
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(starts) != 1)])
    last = np.r_[new[1:], len(starts)] - 1
    lo, hi = starts[new], starts[last]
    return at[new], lo, hi, np.searchsorted(bounds, lo, "right") - 1
