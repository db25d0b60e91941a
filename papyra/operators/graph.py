"""Graphs as edge tables (GR-01..22). Loops run on DataFrames and cut their lineage with ``checkpoint``."""

from __future__ import annotations

from itertools import count
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.levels import Squares
from papyra.session import kept, removed, shared_folder, stored


#: Links of a node in one row, about.
LINKS = 1 << 16


def _steady(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's shared folder (one of our own only where none is set)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def nodes(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.explode(F.array(src, dst)).alias("node")).distinct()


def with_metadata(edges: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """GR-01: every end of an edge is a node, known or not."""
    return nodes(edges).join(metadata, F.col("node") == F.col(key), "left").drop(key)


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair once, smaller id first."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def admitted(edges: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """JN-13, GR-22: edges whose ends both are known ids."""
    ids = known.select(F.col(key).alias("_k")).distinct()
    return edges.join(ids, F.col("src") == F.col("_k"), "left_semi").join(ids, F.col("dst") == F.col("_k"), "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """GR-04: node, in_degree, out_degree, degree."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"), F.count("*").alias("degree"))


def graph_statistics(edges: DataFrame) -> DataFrame:
    """GR-11, AG-28: nodes, edges, density, mean, largest and smallest degree."""
    d = degrees(edges).agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))
    return d.withColumn("density", F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)))


def pagerank(edges: DataFrame, iterations: int = 10, alpha: float = 0.85, weight: str | None = None, tolerance: float | None = None) -> DataFrame:
    """GR-05: ``iterations`` rounds from equal ranks; what dangling nodes hold is spread over all.

    With a ``tolerance`` it ends once the ranks moved by less than that for a node on average, and raises if they don't within the rounds.
    """
    e = _steady(edges.select("src", "dst", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")))
    out = e.groupBy("src").agg(F.sum("w").alias("total"), F.count("*").alias("links"))
    # a node's links of one share are a row, of ``LINKS`` links at most about, so a round sorts and sends rows of nodes
    piece = F.pmod(F.xxhash64("dst"), 1 + F.floor(F.col("links") / LINKS))
    links = e.join(out, "src").groupBy("src", (F.col("w") / F.col("total")).alias("share"), piece.alias("piece")).agg(F.collect_list("dst").alias("to"))
    links = _steady(links.select("src", "share", "to"))
    ids = _steady(nodes(e).join(out.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left").select("node", F.coalesce("dangling", F.lit(True)).alias("dangling")))
    n = ids.count()
    rank = ids.select("node", "dangling", F.lit(1.0 / max(n, 1)).alias("rank"), F.lit(None).cast("double").alias("before"))
    held, moved = F.sum(F.when(F.col("dangling"), F.col("rank")).otherwise(0.0)), F.sum(F.abs(F.col("rank") - F.col("before")))
    for at in range(iterations + (tolerance is not None)):
        loose, change = rank.agg(held, moved).first()
        loose = loose or 0.0
        if tolerance is not None and (n == 0 or change is not None and change < n * tolerance):
            break
        if at == iterations:
            raise RuntimeError("ranks did not settle within the rounds")
        sent = links.join(rank.select(F.col("node").alias("src"), "rank"), "src").select(F.explode("to").alias("node"), (F.col("rank") * F.col("share")).alias("x"))
        got = sent.groupBy("node").agg(F.sum("x").alias("got"))
        new = (1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + loose / n)
        old = rank.select("node", F.col("rank").alias("before"))
        next_ = ids.join(got, "node", "left")
        next_ = next_.join(old, "node") if tolerance is not None else next_.withColumn("before", F.lit(None).cast("double"))
        rank = _steady(next_.select("node", "dangling", new.alias("rank"), "before"))
    return rank.select("node", "rank")


def clustering(edges: DataFrame) -> DataFrame:
    """GR-08: node, triangles, coefficient on the undirected graph. Edges point from lower to higher degree, so a hub has few out."""
    u = _steady(undirected(edges))
    d = u.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    da, db = d.select(F.col("node").alias("a"), F.col("degree").alias("x")), d.select(F.col("node").alias("b"), F.col("degree").alias("y"))
    first = (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & (F.col("a") < F.col("b")))
    o = u.join(da, "a").join(db, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("t"))
    o = _steady(o)
    # a triangle's first edge meets the lists of both its ends: as many rows as edges, not as pairs of a node's edges
    ahead = o.groupBy("s").agg(F.collect_list("t").alias("own"))  # sqrt(2 * edges) nodes at most
    met = o.join(ahead.select(F.col("s").alias("t"), F.col("own").alias("theirs")), "t").join(ahead, "s")
    tri = met.select("s", F.col("t").alias("t1"), F.explode(F.array_intersect("own", "theirs")).alias("t2"))
    counts = tri.select(F.explode(F.array("s", "t1", "t2")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    rows = d.join(counts, "node", "left").select("node", "degree", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))
    return rows.withColumn("coefficient", F.when(F.col("degree") > 1, F.col("triangles") / pairs).otherwise(0.0))


def connected(edges: DataFrame) -> DataFrame:
    """GR-09: node, component (its smallest node). Each round, a label goes to the neighbours and then to its label's label."""
    both = _steady(undirected(edges).select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y"))
    label = _steady(nodes(edges).select("node", F.col("node").alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("m"))
        new = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        jump = new.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = _steady(new.join(jump, F.col("component") == F.col("via")).select("node", F.least("component", "far").alias("component"), "old"))
        if new.where("component <> old").limit(1).count() == 0:
            return new.select("node", "component")
        label = new.select("node", "component")


def communities(edges: DataFrame, least: float = 0.0, score: str | None = None, size: int = 2) -> DataFrame:
    """GR-16, IR-14: components of at least ``size`` nodes over edges at or above a score."""
    c = connected(edges.where(F.col(score) >= least) if score else edges)
    big = c.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= size)
    return c.join(big, "component").select("node", "component", "size")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hops): fewest hops along edges, up to ``depth``."""
    seen = _steady(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops")))
    front = seen
    for d in range(1, depth + 1):
        step = front.select("seed", F.col("node").alias("src")).join(edges.select("src", "dst"), "src").select("seed", F.col("dst").alias("node")).distinct()
        front = _steady(step.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def all_distances(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(seed, node, hops, paths): distances and numbers of shortest paths from every node, or from the nodes of ``seeds``. As many rows as reachable pairs."""
    e = _steady(edges.select("src", "dst").distinct())
    start = nodes(edges) if seeds is None else seeds
    seen = front = _steady(start.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops"), F.lit(1.0).alias("paths")))
    for d in count(1):
        step = front.select("seed", F.col("node").alias("src"), "paths").join(e, "src").groupBy("seed", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = _steady(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(d).alias("hops"), "paths"))
        if front.limit(1).count() == 0:
            return seen
        seen = _steady(seen.unionByName(front))
    return seen


def closeness(edges: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """GR-07: over incoming distances, scaled by the share of nodes that reach the node."""
    d = (distances if distances is not None else all_distances(edges)).where("hops > 0")
    n = nodes(edges).count()
    into = d.groupBy("node").agg(F.count("*").alias("r"), F.sum("hops").alias("far"))
    value = F.col("r") / F.col("far") * F.col("r") / max(n - 1, 1)
    return nodes(edges).join(into, "node", "left").select("node", F.coalesce(value, F.lit(0.0)).alias("closeness"))


#: Bytes of a block's sketches, bytes of all sketches at a time (about), strips at most.
BLOCK, STATE, STRIPS = 1 << 25, 1 << 29, 8


def _in_blocks(edges: DataFrame, ids: DataFrame, blocks: int) -> DataFrame:
    """(src, block, to): a node's links into a block of nodes are a row, itself among them. Blocks are ranges of ids, as linked ids are often near."""
    place = _steady(ids.repartitionByRange(blocks, "node").select("node", F.spark_partition_id().alias("block")))
    ends = edges.where("src <> dst").unionByName(ids.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    return ends.join(place.withColumnRenamed("node", "dst"), "dst").groupBy("src", "block").agg(F.collect_list("dst").alias("to"))


def _balls(links: DataFrame, own: DataFrame, lg_k: int) -> tuple[DataFrame, str]:
    """(node, size, far) and their folder: how many of the nodes ``own`` reach a node, and the sum of their distances."""
    spark = links.sparkSession
    first = own.groupBy("node").agg(F.hll_sketch_agg("node", F.lit(lg_k)).alias("sketch"))
    ball, folder = stored(first.withColumns({"size": F.lit(1).cast("bigint"), "before": F.lit(0).cast("bigint"), "far": F.lit(0).cast("bigint"), "fresh": F.lit(True)}), "balls")
    for d in count(1):
        # a sketch travels once for each block it has links into, not for each link; one that is as before stays where it is
        to = F.when(F.col("fresh"), F.col("to")).otherwise(F.filter("to", lambda x: x == F.col("src")))
        sent = links.join(ball.withColumnRenamed("node", "src"), "src").select("block", "src", to.alias("to"), "sketch", "size", "far").where(F.size("to") > 0)
        each = sent.repartition("block").withColumn("node", F.explode("to"))
        mine = lambda c: F.max(F.when(F.col("src") == F.col("node"), F.col(c)))
        grown = each.groupBy("block", "node").agg(F.hll_union_agg("sketch").alias("sketch"), mine("sketch").alias("old"), mine("size").alias("before"), mine("far").alias("far"))
        before = F.coalesce("before", F.lit(0))
        size = F.greatest(F.hll_sketch_estimate("sketch"), before)
        far = F.coalesce("far", F.lit(0)) + d * (size - before)
        fresh = F.col("old").isNull() | (F.col("old") != F.col("sketch"))
        last, (ball, folder) = folder, stored(grown.select("node", "sketch", size.alias("size"), before.alias("before"), far.alias("far"), fresh.alias("fresh")), "balls")
        removed(spark, last)
        if ball.where("size > before").limit(1).count() == 0:
            return ball.select("node", "size", "far"), folder


def sketched_closeness(edges: DataFrame, lg_k: int = 12) -> DataFrame:
    """GR-07 at scale: (node, reached, closeness) with cardinality sketches for each node instead of rows for pairs.

    A node's sketch counts the nodes that reach it within d hops; a round unites it with those of its predecessors, along edges, and what it grows by
    is as many nodes at distance d. Rounds end when no estimate grows, after as many as the longest shortest path. On a large graph the nodes to be counted are cut
    by hash into strips, counted one after another with as many registers in all, so that disk holds a part of the sketches at a time. State is at most
    2^lg_k registers for each node. The relative standard error of a count is 0.83 / sqrt(2^lg_k), 1.3 % by default; counts of few nodes (an eighth of the registers)
    are exact but for hash clashes. Closeness is the square of one count by a sum of others, so its error is about three times as large.
    """
    spark = edges.sparkSession
    e, edge_folder = stored(edges.select("src", "dst").distinct(), "edges")
    ids, id_folder = stored(nodes(e), "nodes")
    n = ids.count()
    strips = 1
    while strips < min(STRIPS, 1 << max(lg_k - 7, 0)) and n << lg_k > strips * STATE:
        strips *= 2
    lg = lg_k - strips.bit_length() + 1
    links, link_folder = stored(_in_blocks(e, ids, max(1, -(-n // max(1, BLOCK >> lg)))), "links")
    # the sketches of a block are held, not sorted
    held, most = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold")
    spark.conf.set(held, str(4 * max(1, BLOCK >> lg)))
    found = []
    try:
        for strip in range(strips):
            ball, folder = _balls(links, ids.where(F.pmod(F.xxhash64(F.lit("strip"), "node"), F.lit(strips)) == strip), lg)
            found.append(stored(ball, "counts"))
            removed(spark, folder)
    finally:
        spark.conf.set(held, most)
    total = found[0][0]
    for part, _ in found[1:]:
        total = total.unionByName(part)
    total = total.groupBy("node").agg((F.sum("size") - 1).alias("reached"), F.sum("far").alias("far"))
    value = F.when(F.col("far") > 0, F.col("reached") / F.col("far") * F.col("reached") / max(n - 1, 1)).otherwise(0.0)
    return kept(total.select("node", "reached", value.alias("closeness")), edge_folder, id_folder, link_folder, *[folder for _, folder in found])


def _dependencies(edges: DataFrame, d: DataFrame) -> DataFrame:
    """(seed, node, dependency): of each seed's shortest paths the share that goes over a node; back level by level."""
    deepest = d.agg(F.max("hops")).first()[0] or 0
    e = _steady(edges.select("src", "dst").distinct())
    parts = [d.where(F.col("hops") == deepest).select("seed", "node", "paths", F.lit(0.0).alias("dependency"))]
    for level in range(deepest - 1, 0, -1):
        below = parts[-1].select("seed", F.col("node").alias("dst"), F.col("paths").alias("p2"), "dependency")
        own = d.where(F.col("hops") == level).select("seed", "node", "paths")
        share = own.join(e, F.col("node") == F.col("src")).join(below, ["seed", "dst"]).groupBy("seed", "node").agg(F.sum(F.col("paths") / F.col("p2") * (1 + F.col("dependency"))).alias("dependency"))
        parts.append(_steady(own.join(share, ["seed", "node"], "left").select("seed", "node", "paths", F.coalesce("dependency", F.lit(0.0)).alias("dependency"))))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.where("seed <> node").select("seed", "node", "dependency")


def betweenness(edges: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """GR-06: share of shortest paths over a node, summed over pairs, by (n - 1)(n - 2)."""
    n = nodes(edges).count()
    total = _dependencies(edges, distances if distances is not None else all_distances(edges)).groupBy("node").agg(F.sum("dependency").alias("s"))
    return nodes(edges).join(total, "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) / max((n - 1) * (n - 2), 1)).alias("betweenness"))


#: Seeds of batches that are taken together, at most.
TOGETHER = 512


def sampled_betweenness(edges: DataFrame, error: float = 0.05, doubt: float = 0.1, batch: int = 32) -> DataFrame:
    """GR-06 at scale: (node, betweenness, seeds) from the shortest paths of sampled seeds.

    With probability 1 - ``doubt`` no node is off by more than ``error``. Seeds (in order of their hashes, ``batch`` at a time) are added until the empirical
    Bernstein bound, over all nodes and all looks at it, is within the error for every node; a seed's share of a node is between 0 and 1. If all nodes become seeds, the
    result is exact. Batches after which the bound can't be met, whatever the shares are, are taken together, ``TOGETHER`` seeds at most, and all seeds' paths are
    spread as pairs of a node and a seed, see ``levels``.
    """
    e = _steady(edges.select("src", "dst").distinct())
    every = _steady(nodes(e).withColumns({"h": F.xxhash64(F.lit("seed"), "node"), "no": F.monotonically_increasing_id()}))
    n = every.count()
    scale = max(n - 2, 1)
    squares = Squares(e, every.select("node", "no"), n)
    held = every.select("node", "no", F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    used, last, look = 0, None, 0
    term = lambda look: log(3 * max(n, 1) * look * (look + 1) / doubt)
    while used < n:
        rest = every if last is None else every.where(F.col("h") > last)
        more = 1
        while (more + 1) * batch <= TOGETHER and used + more * batch < n and 3 * term(look + more) / (used + more * batch) * n / max(n - 1, 1) > error:
            more += 1
        some = _steady(rest.orderBy("h").limit(more * batch).select("no", "h"))  # ``TOGETHER`` rows, or ``batch``
        last, size = some.agg(F.max("h"), F.count("*")).first()
        if not size:
            break
        seeds = some.select("no", (F.row_number().over(Window.orderBy("h")) - 1).alias("i"))
        part = squares.dependencies(seeds).select("no", (F.col("s") / scale).alias("s1"), (F.col("q") / scale**2).alias("q1"))
        held = _steady(held.join(part, "no", "left").select("node", "no", (F.col("s") + F.coalesce("s1", F.lit(0.0))).alias("s"), (F.col("q") + F.coalesce("q1", F.lit(0.0))).alias("q")))
        used, look = used + size, look + more
        if used > 1:
            spread = F.greatest((F.col("q") - F.col("s") * F.col("s") / used) / (used - 1), F.lit(0.0))
            worst = held.agg(F.max(F.sqrt(2 * spread * term(look) / used) + 3 * term(look) / used)).first()[0]
            if worst * n / max(n - 1, 1) <= error:
                break
    return held.select("node", (F.col("s") / max(used, 1) * n / max(n - 1, 1)).alias("betweenness"), F.lit(used).alias("seeds"))


def _least_reaching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, color): the smallest node from which a node can be reached. A label goes one edge on and then to its label's label."""
    color = _steady(ids.select("node", F.col("node").alias("color")))
    while True:
        got = edges.join(color.select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("m"))
        new = color.join(got, "node", "left").select("node", F.least("color", F.coalesce("m", "color")).alias("color"), F.col("color").alias("old"))
        jump = color.select(F.col("node").alias("via"), F.col("color").alias("far"))
        new = _steady(new.join(jump, F.col("color") == F.col("via")).select("node", F.least("color", "far").alias("color"), "old"))
        if new.where("color <> old").limit(1).count() == 0:
            return new.select("node", "color")
        color = new.select("node", "color")


def strong_components(edges: DataFrame) -> DataFrame:
    """GR-10: node, component (smallest node that it reaches and that reaches it).

    Nodes get the smallest node that reaches them and the smallest that they reach. Where both are one node, it names the
    component; else edges between unlike pairs of labels go and the rest is labelled anew. Rows stay as many as nodes and edges.
    """
    left, done = _steady(nodes(edges)), None
    e = _steady(edges.where("src <> dst").select("src", "dst").distinct())
    while done is None or left.limit(1).count():
        back = _least_reaching(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), left).withColumnRenamed("color", "back")
        both = _steady(_least_reaching(e, left).join(back, "node"))
        found = both.where("color = back").select("node", F.col("color").alias("component"))
        done = found if done is None else done.unionByName(found)
        rest = both.where("color <> back")
        ends = [rest.select(F.col("node").alias(x), F.struct("color", "back").alias(f"of_{x}")) for x in ("src", "dst")]
        e = _steady(e.join(ends[0], "src").join(ends[1], "dst").where("of_src = of_dst").select("src", "dst"))
        left = rest.select("node")
    return done


def ego_network(edges: DataFrame, node: Column | int, depth: int = 2) -> DataFrame:
    """GR-12: edges among the nodes within ``depth`` hops in either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seed = edges.sparkSession.range(1).select(F.lit(node).alias("node"))
    return admitted(edges, reach(both, seed, depth).select("node").distinct(), "node")


def simple_paths(edges: DataFrame, source: int, target: int, cutoff: int = 5) -> DataFrame:
    """GR-13: ``path`` arrays without a repeated node, of at most ``cutoff`` edges."""
    e = edges.select("src", "dst").distinct()
    front = edges.sparkSession.range(1).select(F.array(F.lit(source)).alias("path"))
    found = None
    for _ in range(cutoff):
        step = front.withColumn("src", F.element_at("path", -1)).join(e, "src").where(~F.array_contains("path", F.col("dst")))
        front = _steady(step.select(F.concat("path", F.array("dst")).alias("path")))
        hit = front.where(F.element_at("path", -1) == target)
        found = hit if found is None else found.unionByName(hit)
        front = front.where(F.element_at("path", -1) != target)
    return found


def chain(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """GR-15, JN-05: (root, node, level) along edges below ``depth`` levels; every way counts, duplicates stay."""
    front = seeds.select(F.col("node").alias("root"), "node", F.lit(0).alias("level"))
    out = front
    for level in range(1, depth):
        front = front.select("root", F.col("node").alias("src")).join(edges.select("src", "dst"), "src").select("root", F.col("dst").alias("node"), F.lit(level).alias("level"))
        out = out.unionByName(front)
    return out


def related(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """GR-14: (seed, node, depth) for successors, and for theirs that aren't successors nor the seed."""
    return reach(edges.select("src", "dst").distinct(), seeds, 2).where("hops > 0 and seed <> node").withColumnRenamed("hops", "depth")


def influence(metrics: DataFrame, k: int) -> DataFrame:
    """TK-08: 0.4 pagerank + 0.3 in_degree + 0.3 betweenness."""
    score = 0.4 * F.col("pagerank") + 0.3 * F.col("in_degree") + 0.3 * F.col("betweenness")
    return metrics.withColumn("influence", score).orderBy(F.desc(F.round("influence", 9)), "node").limit(k)


def shared_pairs(df: DataFrame, node: str, item: str, least: float) -> DataFrame:
    """JN-15: (a, b, shared, overlap): pairs that share items, Jaccard of their item sets above ``least``."""
    rows = df.select(F.col(node).alias("n"), F.col(item).alias("i")).distinct()
    sizes = rows.groupBy("n").agg(F.count("*").alias("s"))
    met = rows.select(F.col("n").alias("a"), "i").join(rows.select(F.col("n").alias("b"), "i"), "i").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sa, sb = sizes.select(F.col("n").alias("a"), F.col("s").alias("sa")), sizes.select(F.col("n").alias("b"), F.col("s").alias("sb"))
    overlap = F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))
    return met.join(sa, "a").join(sb, "b").select("a", "b", "shared", overlap.alias("overlap")).where(F.col("overlap") > least)
