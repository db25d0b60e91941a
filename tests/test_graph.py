"""Hand-checked graphs."""

from __future__ import annotations

import random

import pytest

from papyra.operators import graph as G


@pytest.fixture(scope="module")
def edges(spark):
    return lambda *pairs: spark.createDataFrame(list(pairs), "src string, dst string")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_degrees_of_a_star(edges):
    d = {r.node: (r.out_degree, r.in_degree, r.degree) for r in G.degrees(edges(("c", "r1"), ("c", "r2"), ("x", "c"))).collect()}
    assert d["c"] == (2, 1, 3)


def test_chain_has_one_path(edges):
    e = edges(("p1", "p2"), ("p2", "p3"), ("p3", "p4"))
    assert [r.path for r in G.simple_paths(e, "p1", "p4").collect()] == [["p1", "p2", "p3", "p4"]]
    assert G.simple_paths(e, "p4", "p1").count() == 0


def test_bridge_is_one_component(edges):
    e = edges(*[(f"p{i}", f"p{i + 1}") for i in range(1, 6)], ("q1", "q2"))
    assert {c for _, c in rows(G.connected(e), "node", "component")} == {"p1", "q1"}


def test_triangle_clusters_fully(edges):
    assert {c for _, c in rows(G.clustering(edges(("1", "2"), ("1", "3"), ("2", "3"))), "node", "coefficient")} == {1.0}


def test_betweenness_and_closeness_of_a_chain(edges):
    e = edges(("a", "b"), ("b", "c"))
    assert rows(G.betweenness(e), "node", "betweenness") == [("a", 0.0), ("b", 0.5), ("c", 0.0)]
    assert rows(G.closeness(e), "node", "closeness") == [("a", 0.0), ("b", 0.5), ("c", pytest.approx(2 / 3))]


def test_strong_components(edges):
    e = edges(("a", "b"), ("b", "a"), ("b", "c"))
    assert rows(G.strong_components(e), "node", "component") == [("a", "a"), ("b", "a"), ("c", "c")]


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((30, 40), (25, 60), (70, 69)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n < 70 else [(i, i + 1) for i in rng.sample(range(69), 69)]
        reached = {x: {x} for x in {x for p in pairs for x in p}}
        for _ in reached:
            for a, b in pairs:
                reached[a] |= reached[b]
        want = sorted((x, min(y for y in reached[x] if x in reached[y])) for x in reached)
        assert rows(G.strong_components(spark.createDataFrame(pairs, "src int, dst int")), "node", "component") == want


def test_pagerank_settles(edges):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d")]
    ids, rank = "abcd", dict.fromkeys("abcd", 0.25)
    while True:
        out = {x: sum(p[0] == x for p in pairs) for x in ids}
        new = {x: 0.15 / 4 + 0.85 * (sum(rank[a] / out[a] for a, b in pairs if b == x) + rank["d"] / 4) for x in ids}
        change, rank = sum(abs(new[x] - rank[x]) for x in ids), new
        if change < 4e-4:
            break
    got = dict(rows(G.pagerank(edges(*pairs), 100, tolerance=1e-4), "node", "rank"))
    assert got == pytest.approx(rank, abs=1e-12)
    with pytest.raises(RuntimeError):
        G.pagerank(edges(*pairs), 1, tolerance=1e-9)


def test_pagerank_sums_to_one(edges):
    ranks = [r for _, r in rows(G.pagerank(edges(("a", "b"), ("b", "c"), ("a", "c")), 30), "node", "rank")]
    assert sum(ranks) == pytest.approx(1.0) and ranks[2] == max(ranks)


def test_related_leaves_out_the_seed_and_nearer_nodes(edges, spark):
    e = edges(("a", "b"), ("b", "c"), ("b", "a"), ("a", "d"), ("d", "b"))
    assert rows(G.related(e, spark.createDataFrame([("a",)], "node string")), "node", "depth") == [("b", 1), ("c", 2), ("d", 1)]


def test_chain_keeps_every_way(edges, spark):
    e = edges(("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"))
    assert rows(G.chain(e, spark.createDataFrame([("a",)], "node string")), "node", "level").count(("d", 2)) == 2


def test_density_of_five_nodes(edges):
    s = G.graph_statistics(edges(("0", "1"), ("0", "2"), ("1", "2"), ("2", "3"), ("3", "4"))).first()
    assert (s.nodes, s.edges, s.density) == (5, 5, 0.25)


@pytest.mark.parametrize("metric", [lambda e: G.pagerank(e, 2), G.clustering], ids=["pagerank", "clustering"])
def test_edges_are_read_once(spark, metric):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    assert metric(e.mapInArrow(counted, e.schema)).count() == 4 and read.value == 4


def test_links_of_a_node_in_several_rows(spark, monkeypatch):
    rows = [(1, i, float(1 + i % 2)) for i in range(2, 12)] + [(i, 1, 1.0) for i in range(2, 9)] + [(1, 2, 1.0)]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    whole = {r.node: r["rank"] for r in G.pagerank(e, 5, weight="weight").collect()}
    monkeypatch.setattr(G, "LINKS", 2)
    assert {r.node: r["rank"] for r in G.pagerank(e, 5, weight="weight").collect()} == pytest.approx(whole) and sum(whole.values()) == pytest.approx(1)
