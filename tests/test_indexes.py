"""Stored vector indexes: recall against the exact scan, what is read, odd rows."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.operators import indexes as I
from papyra.operators import vectors as V

SCHEMA = "vec_id bigint, embedding array<float>, v string, list string"


@pytest.fixture(scope="module")
def rows(spark):
    """Clusters of unequal size, one with a third of all rows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    own = np.where(rng.random(900) < 0.33, 0, rng.integers(0, 12, 900))
    v = centres[own] + rng.normal(scale=0.5, size=(900, 16))
    return spark.createDataFrame([(i, x.tolist(), "a", "b") for i, x in enumerate(v)], SCHEMA).cache()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_lists(spark, tmp_path, rows, metric):
    index = I.ListIndex.build(rows, f"file://{tmp_path}/{uuid.uuid4().hex}", 10, metric, sample=400)
    assert sum(index.sizes.values()) == 900
    asked = rows.where("vec_id % 20 = 0")
    exact = V.search(asked, rows, 20, metric).cache()
    every = {(r.query_id, r.rank, r.id): r.score for r in index.search(asked, 20, 10).collect()}
    assert every == pytest.approx({(r.query_id, r.rank, r.id): r.score for r in exact.collect()})
    probes = index.probes_for(asked, 20, 0.9)
    assert probes < 10 and I.recall(index.search(asked, 20, probes), exact) >= 0.9
    assert I.recall(index.search(asked, 20, 1), exact) < 1
    plan = index.rows([3, 4])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan  # files of other lists aren't read
    assert {f.rpartition("list=")[2][:2] for (f,) in index.rows([3, 4]).select(F.input_file_name()).distinct().collect()} <= {"3/", "4/"}
    assert I.ListIndex.load(spark, index.path).sizes == index.sizes


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_graph(tmp_path, rows, metric):
    index = I.GraphIndex.build(rows, f"file://{tmp_path}/{uuid.uuid4().hex}", 16, metric)
    asked = rows.where("vec_id % 20 = 0")
    assert I.recall(index.search(asked, 20, beam=48), V.search(asked, rows, 20, metric)) >= 0.9


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_rows_meet_few_others(tmp_path, rows, metric, monkeypatch):
    """A row meets at most OVERLAP parts of REGION rows, about, though a third of all rows are one cluster; links still find the nearest."""
    for name, value in (("SHARE", 30), ("OVERLAP", 5), ("REGION", 100)):
        monkeypatch.setattr(I, name, value)
    placed = I.regions(I.prepared(rows, metric, "vec_id", "embedding"), 900, metric)
    assert {r["count"] for r in placed.groupBy("id").count().collect()} == {5}
    assert placed.groupBy("list", "part").count().agg(F.max("count")).first()[0] < 150
    index = I.GraphIndex.build(rows, f"file://{tmp_path}/{uuid.uuid4().hex}", 16, metric)
    asked = rows.where("vec_id % 20 = 0")
    assert I.recall(index.search(asked, 20, beam=48), V.search(asked, rows, 20, metric)) >= 0.9


def test_descent_after_regions(tmp_path, rows):
    index = I.GraphIndex.build(rows, f"file://{tmp_path}/{uuid.uuid4().hex}", 16, rounds=2)
    asked = rows.where("vec_id % 20 = 0")
    assert I.recall(index.search(asked, 20, beam=48), V.search(asked, rows, 20)) >= 0.9


def test_pairs_compared_are_few(rows):
    """Neighbours of a node are compared with each other only, and of a task's pairs each node keeps its best."""
    import pyarrow as pa

    t = pa.table({"node": [1, 1, 1, 2, 2], "other": [5, 6, 7, 5, 9], "new": [True, False, False, True, True], "v": [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [2.0, 0.0]]})
    got = sorted(zip(*(c.to_pylist() for c in I._local_pairs("inner_product", 2)(t).columns)))
    assert got == [(5, 7, 1.0), (5, 9, 2.0), (6, 5, 0.0), (7, 5, 1.0), (9, 5, 2.0)]


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 0.0], "", ""), (2, None, "", ""), (3, [0.0, 0.0], "", ""), (4, [1.0, 0.0], "", ""), (5, [0.0, 2.0], "", "")], SCHEMA)
    index = I.ListIndex.build(df, f"file://{tmp_path}/a", 8)
    assert sum(index.sizes.values()) == 3
    assert [(r.query_id, r.rank, r.id) for r in index.search(df.where("vec_id = 1"), 5, 8).collect()] == [(1, 1, 4), (1, 2, 5)]
    none = I.ListIndex.build(df.limit(0), f"file://{tmp_path}/b", 8)
    assert none.search(df, 5).count() == 0
    graph = I.GraphIndex.build(df, f"file://{tmp_path}/c", 4)
    assert {(r.query_id, r.id) for r in graph.search(df.where("vec_id = 1"), 5).collect()} == {(1, 4), (1, 5)}
    assert math.isclose(graph.search(df.where("vec_id = 1"), 1).first()["score"], 1.0)
    assert I.GraphIndex.build(df.limit(0), f"file://{tmp_path}/d", 4).search(df, 5).count() == 0
