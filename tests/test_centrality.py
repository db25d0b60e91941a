"""Centralities by sketches and samples against the exact ones."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from papyra import tables
from papyra.operators import graph as G
from papyra.operators import levels
from papyra.session import shared_folder


def graph(spark, n: int, m: int, seed: int):
    rng = random.Random(seed)
    return spark.createDataFrame(list({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} - {(i, i) for i in range(n)}), "src int, dst int").cache()


def test_sketched_closeness(spark):
    e = graph(spark, 80, 160, 1)
    exact = {r.node: r.closeness for r in G.closeness(e).collect()}
    assert {r.node: r.closeness for r in G.sketched_closeness(e).collect()} == pytest.approx(exact)  # so few nodes are counted exactly
    rough = {r.node: r.closeness for r in G.sketched_closeness(e, lg_k=7).collect()}
    assert all(abs(rough[k] - v) <= 3 * 3 * 0.83 / 2**3.5 * v + 1e-9 for k, v in exact.items())


def test_sketches_in_strips_of_nodes(spark, monkeypatch):
    """Four strips, several blocks of nodes: estimates of the same error, exact for so few nodes."""
    monkeypatch.setattr(G, "STATE", 1 << 17)
    monkeypatch.setattr(G, "STRIPS", 4)
    monkeypatch.setattr(G, "BLOCK", 1 << 15)
    e = graph(spark, 80, 160, 1)
    exact = {r.node: r.closeness for r in G.closeness(e).collect()}
    assert {r.node: r.closeness for r in G.sketched_closeness(e).collect()} == pytest.approx(exact)


def test_sketches_of_finished_rounds_are_removed(spark):
    """Only the counts stay in the shared folder, not the sketches of every round."""
    held = lambda: sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("*") if p.is_file())
    e = graph(spark, 300, 900, 4)
    e.count()
    before = held()
    rows = G.sketched_closeness(e).collect()
    assert len(rows) > 250 and held() - before < 300 * 256


def test_sampled_betweenness(spark):
    e = graph(spark, 50, 130, 2)
    exact = {r.node: r.betweenness for r in G.betweenness(e).collect()}
    every = G.sampled_betweenness(e, error=0.0, batch=25).collect()
    assert {r.node: r.betweenness for r in every} == pytest.approx(exact) and {r.seeds for r in every} == {len(exact)}
    some = G.sampled_betweenness(e, error=0.9, batch=20).collect()
    assert max(abs(r.betweenness - exact[r.node]) for r in some) <= 0.9 and some[0].seeds < len(exact)


def test_no_edges(spark):
    e = spark.createDataFrame([], "src int, dst int")
    assert G.sketched_closeness(e).count() == 0 and G.sampled_betweenness(e).count() == 0


def test_trade_graph_is_stored(spark):
    """What is built on the nations' graph doesn't join the order lines again."""
    e = tables.nation_edges(spark, "/root/testdata/sf0.01")
    assert e.inputFiles() == [] and e.count() > 0


def test_levels_in_squares(spark, monkeypatch):
    """Three blocks of nodes with names, and seeds in two slices: a node's row travels once for each block."""
    monkeypatch.setattr(levels, "NODES", 10)
    e = graph(spark, 24, 60, 3).select(*[F.concat(F.lit("n"), x).alias(x) for x in ("src", "dst")])
    exact = {r.node: r.betweenness for r in G.betweenness(e).collect()}
    assert {r.node: r.betweenness for r in G.sampled_betweenness(e, error=0.0, batch=24).collect()} == pytest.approx(exact)


def test_links_are_packed_and_hopeless_batches_taken_together(spark, monkeypatch):
    """A square's links are a row, not a row for each link and slice of seeds at every level; batches that can't meet the bound are one walk, with the looks of all."""
    walks, walk = [], levels.Squares.dependencies

    def counted(self, seeds):
        walks.append((seeds.count(), self.links.count(), self.back.count()))
        return walk(self, seeds)

    monkeypatch.setattr(levels.Squares, "dependencies", counted)
    monkeypatch.setattr(levels, "PAIRS", 7)
    e = graph(spark, 50, 130, 5)
    exact = {r.node: r.betweenness for r in G.betweenness(e).collect()}
    every = G.sampled_betweenness(e, error=0.0, batch=10).collect()
    assert {r.node: r.betweenness for r in every} == pytest.approx(exact) and walks == [(len(exact), 1, 1)]
