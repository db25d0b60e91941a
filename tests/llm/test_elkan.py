"""Bounds skip distances but change nothing: equal to all distances in every round, ties and odd rows included."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import elkan as E

SCHEMA = "vec_id bigint, embedding array<double>, cluster int, distance string, x string, sums string, upper double"
SMALL = E.ElkanSetting(k=3, dim=2, scale=1, rounds=4)


def plain(vectors: dict, first: list, rounds: int) -> tuple[dict, list]:
    c = [list(v) for v in first]
    for step in range(rounds + 1):
        near = {i: min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j])), j)) for i, v in vectors.items()}
        if step == rounds:
            return near, c
        for j in range(len(c)):
            own = [v for i, v in vectors.items() if near[i] == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=40), st.integers(1, 5), st.sampled_from([1, 1 << 40]))
def test_bounds_keep_every_tie(points, k, by):
    x = E._rows([[a * by, b * by] for a, b in points])
    c = E._rows([[a * by, b * by] for a, b in (points * k)[:k]])
    cluster, upper, lower, old = np.zeros(len(x), np.int32), np.full(len(x), np.inf), np.zeros((len(x), k)), c
    for _ in range(4):
        shift = E._root(E.distances(old, c), True)
        upper, lower = (upper + shift[cluster]) * (1 + E.ROOM), np.maximum(0, (lower - shift) * (1 - E.ROOM))
        E.assign(x, cluster, upper, lower, c, E.half_distances(c))
        want = [min(range(k), key=lambda j: (sum(int(p - q) ** 2 for p, q in zip(v, c[j])), j)) for v in x]
        assert cluster.tolist() == want
        old, c = c, E._rows([[int(s) // len(own) for s in own.sum(0)] if len(own := x[cluster == j]) else list(c[j]) for j in range(k)])


def test_cluster_equals_all_distances(spark):
    rng = np.random.default_rng(1)
    vectors = {i: [int(v) for v in rng.integers(-9, 9, 2)] for i in range(200)}
    df = spark.createDataFrame([(i, [float(a) for a in v], None, "a", "b", "c", 0.0) for i, v in vectors.items()], SCHEMA)
    found = E.cluster(df, SMALL)
    import hashlib

    first = [vectors[i] for i in sorted(vectors, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:3]]
    near, centroids = plain(vectors, first, SMALL.rounds)
    assert found.centroids == centroids
    assert {r.vec_id: r.cluster for r in found.vectors.collect()} == near
    assert sum(found.computed) < 200 * 3 * (SMALL.rounds + 1)  # some distances were skipped
    assert sum(found.inertia) == sum(r.distance for r in found.vectors.collect())


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, []), (None, [3.0, 3.0]), (7, [1e30, -1e30])]
    df = spark.createDataFrame([(*r, 9, "d", "x", "s", 1.5) for r in rows] + [(8, [None, 1.0], 9, "d", "x", "s", 1.5)], SCHEMA)
    got = E.digest(E.cluster(df, SMALL)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "7", "None"]
    assert all(0 <= r.distance <= E.MOST for r in got)


@pytest.mark.parametrize("rows", [[], [(1, [2.5, -2.5], 0, "", "", "", 0.0)]])
def test_few_vectors(spark, rows):
    found = E.cluster(spark.createDataFrame(rows, SCHEMA), SMALL)
    assert E.digest(found).count() == len(rows) and found.centroids == [[2, -3]] * len(rows)
