"""Hashes of words and of runs of words over many texts at once: a fixed number of array passes, no step for each word.

Unless other blanks are given, words are the runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
STEP = 0xD1342543DE82EF95
#: Bytes of words hashed in one pass.
SPAN = 1 << 19

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a buffer of texts, cut at the bytes that ``blank`` marks: ``starts`` and ``ends`` in bytes, ``doc`` (text of each word), ``first`` (word at which a text begins), ``count``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK):
        word = ~blank[raw]
        left, right = word.copy(), word.copy()
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        if len(raw):
            left[1:] &= ~word[:-1]
            right[:-1] &= ~word[1:]
            left[inner], right[inner - 1] = word[inner], word[inner - 1]
        self.raw, self.starts, self.ends = raw, np.flatnonzero(left), np.flatnonzero(right) + 1
        bounds = np.searchsorted(self.starts, offsets)
        self.first, self.count = bounds[:-1], np.diff(bounds)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        out, at, n = np.empty(len(self.starts), np.uint64), 0, len(self.starts)
        while at < n:
            end = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + SPAN, side="right")))
            low, high = self.starts[at], self.ends[end - 1]
            size = 1 << int(high - low).bit_length()
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((self.raw[low:high].astype(np.uint64) + np.uint64(1)) * _powers(size, BASE)[: high - low], out=sums[1:])
            s, e = self.starts[at:end] - low, self.ends[at:end] - low
            out[at:end] = (sums[e] - sums[s]) * _powers(size, pow(BASE, -1, 1 << 64))[s] + (e - s).astype(np.uint64)
            at = end
        return mix(out)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place; runs over the end of a text are made too, the caller leaves them out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, held, size = np.zeros(n, np.uint64), 0, words, 1
    while k:
        if k & 1:
            total = total + held[done : done + n] * np.uint64(pow(STEP, done, 1 << 64))
            done += size
        k >>= 1
        if k:
            held = held[: len(held) - size] + held[size:] * np.uint64(pow(STEP, size, 1 << 64))
            size *= 2
    return mix(total)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` values in a row, the leftmost of equals."""
    place, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(values[b] < values[a], b, a)
        size += step
    return place
