"""Strings whose edit ratio is above a threshold, by segments (JN-08, SF-18): an equi-join that loses no pair.

A string of length L, the longer of a pair, is cut into d + 1 segments of like length, where d is the largest edit distance that keeps
1 - distance / L above the ratio. d edits leave one segment untouched at least, and it stands in the shorter string at nearly the same place:
of segment i (from 0) no more than i edits need to be before it and d - i after it, which bounds the places on both sides. (This is the
partition scheme of Li, Deng, Wang, Feng: Pass-Join, 2011.) So the longer side sends a row for each segment, the shorter one a row for each place where
a segment of a string of each possible length could stand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
ROOM = 1e-9


def most_edits(length: int, ratio: float) -> int:
    """The largest d with 1 - d / length > ratio."""
    return max(0, math.ceil((1 - ratio) * length - ROOM) - 1)


@lru_cache(maxsize=4096)
def segments(length: int, ratio: float) -> tuple[tuple[int, int], ...]:
    """(start, size) of the segments of a string of this length; those of no size are left out, as they would fit anywhere (only with d >= length, below ratio 0)."""
    n = most_edits(length, ratio) + 1
    small, out, at = length // n, [], 0
    for i in range(n):
        size = small + (i >= n - length % n)
        out.append((at, size))
        at += size
    return tuple(out)


@lru_cache(maxsize=4096)
def places(length: int, ratio: float, equal: bool) -> np.ndarray:
    """Rows (start, size, length of the longer string, segment): where segments of strings at least as long (or longer) may stand in one of this length."""
    out = []
    longer = length if equal else length + 1
    while True:
        d = most_edits(longer, ratio)
        if longer - length > d:
            if longer * ratio > length + 1:
                break
        else:
            for i, (at, size) in enumerate(segments(longer, ratio)):
                shift = length - longer
                low = max(0, at - i, at + shift - (d - i))
                high = min(length - size, at + i, at + shift + (d - i))
                out += [(j, size, longer, i) for j in range(low, high + 1)]
        longer += 1
    return np.array(out, np.int64).reshape(-1, 4)


def _keys(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hash of each of the named places of strings of one length, and of the length and segment they stand for; strings are rows."""
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(codes.shape[1], BASE, np.uint64)]), dtype=np.uint64)
    sums = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum((codes + np.uint64(1)) * powers[1:], axis=1, out=sums[:, 1:])
    start, size, longer, i = rows.T
    # sums grow with the place; brought to one power by what is missing up to the longest
    h = (sums[:, start + size] - sums[:, start]) * powers[codes.shape[1] - start]
    h = h * np.uint64(pow(int(BASE), -codes.shape[1], 1 << 64))
    salt = (longer * 4099 + i).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + salt
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _signed(ratio: float, longer_side: bool, equal: bool):
    """(key, s) of each string: its segments, or the places of segments of longer strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("s").to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            for n in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == n)
                rows = np.array([(x, y, n, i) for i, (x, y) in enumerate(segments(int(n), ratio))], np.int64) if longer_side else places(int(n), ratio, equal)
                for k in range(0, len(at) if len(rows) else 0, max(1, 400_000 // max(1, len(rows)))):
                    part = at[k : k + max(1, 400_000 // len(rows))]
                    codes = np.frombuffer("".join(texts[x] for x in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), n).astype(np.uint64)
                    keys = _keys(codes, rows)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column("s").take(pa.array(np.repeat(part, len(rows))))], names=["key", "s"])

    return run


def similar_strings(a: DataFrame, b: DataFrame, ratio: float, left: str = "a", right: str = "b") -> DataFrame:
    """(a, b): all pairs of a string of the one and of the other table (column ``s``) whose edit ratio is above ``ratio``; repeated strings meet once, empty ones not at all.

    Lengths count characters as Spark does, so strings beyond the basic plane are told apart by code points.
    """
    one, two = (x.select("s").where("s <> ''").distinct() for x in (a, b))
    found = []
    for longer, shorter, equal in ((two, one, True), (one, two, False)):
        known = longer.mapInArrow(_signed(ratio, True, True), "key bigint, s string").distinct()
        asked = shorter.mapInArrow(_signed(ratio, False, equal), "key bigint, s string")
        met = asked.withColumnRenamed("s", "x").join(known.withColumnRenamed("s", "y"), "key").select("x", "y").distinct()
        found.append(met.select(F.col("x" if longer is two else "y").alias(left), F.col("y" if longer is two else "x").alias(right)))
    pairs = found[0].union(found[1])
    return pairs.where(F.expr(f"levenshtein({left}, {right}, cast(greatest(0, ceil({1 - ratio!r} * greatest(length({left}), length({right})) - {ROOM!r}) - 1) as int)) >= 0"))
