"""The forest against all pairs: planted copies, dense regions that are cut or compared in blocks, odd rows."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from papyra.llm import lsh_forest as L
from papyra.llm.prefix_join import shingle_sets

SCHEMA = "doc_id bigint, text string, node string, region string, n string, d string, size string"


def sets_of(rows: list[tuple]) -> dict:
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        out[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    return out


def plain(rows: list[tuple]) -> dict:
    sets = sets_of(rows)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def crowd(seed: int, groups: int = 12, copies: int = 14) -> list[tuple]:
    """Copies with more and more words changed, and texts that share a long passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage, rows = rng.choices(words, k=60), []
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([5, 9, 40, 120]))
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 20))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(passage + text if g % 3 == 0 else text)))
    return rows


@pytest.mark.parametrize("region, gain", [(2048, 0.7), (8, 0.7), (8, 0.0), (8, 99.0)])
def test_equals_all_pairs(spark, monkeypatch, region, gain):
    monkeypatch.setattr(L, "REGION", region)
    monkeypatch.setattr(L, "GAIN", gain)
    rows = crowd(region)
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in L.near_duplicates(df).collect()} == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 997}" for i in range(20_000))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE two"), (5, long), (6, long + " end"), (5, long), (None, "null id"), (None, None)]
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in L.near_duplicates(df).collect()), key=str)
    n = len(sets_of([(5, long)])[5])
    assert got == sorted([(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, n, 5, True), (5, n, 5, True), (6, n + 1, 5, False), (None, 1, None, True), (None, 0, None, True)], key=str)
    assert L.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    base = [f"a{i}" for i in range(300)]
    other = base[:150] + [f"b{i}" for i in range(20)] + base[170:]
    values, sizes = shingle_sets(pa.array([" ".join(base), " ".join(other), "", "x"]), L.SETTING)
    found = L.signatures(values, sizes)
    assert found.shape == (3, L.HASHES)
    a, b = set(values[: sizes[0]].tolist()), set(values[sizes[0] : sizes[0] + sizes[1]].tolist())
    assert abs((found[0] == found[1]).mean() - len(a & b) / len(a | b)) < 0.12
    assert L.agree(L.SETTING) == 70


def test_neighbours_join_regions_only_across_sides():
    sketch = np.zeros((6, L.HASHES), np.uint8)
    sketch[3:] = 1
    region, tree, node = np.array([1, 1, 1, 1, 2, 2]), np.zeros(6, np.int64), np.arange(6)
    assert len(L.neighbours(region, tree, node, sketch, np.zeros(6, int), 70)) == 3  # 0-1-2 and 4-5
    across = L.neighbours(region, tree, node, sketch, np.array([0, 1, 1, 1, 0, 0]), 70)
    assert {frozenset(p) for p in across} <= {frozenset(p) for p in ((0, 1), (0, 2))} and across
