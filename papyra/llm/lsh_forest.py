"""MinHash near-dedup by an LSH forest: documents in several signature orders, neighbours by common prefix, links confirmed on full sets.

1. Signatures. Documents with equal shingle sets are one node. A node's signature is the minimum of its shingles under
   each of ``HASHES`` hash functions; its sketch is the low byte of each minimum.
2. Forest. Each of ``TREES`` trees orders the nodes by another sequence of their minima; nodes that share the first
   ``DEPTH`` of it stand together, a region. Regions of one node end here.
3. Adaptive depth. A region of more than ``REGION`` nodes is cut by ``STEP`` further minima, along ``BRANCHES`` different
   sequences, so that pairs lost by one are met in the other, and its parts again, as long as that makes the comparisons
   fewer by a good part. What doesn't get smaller (nodes that are nearly the same) is compared in blocks. No region is
   capped.
4. Candidates. Within a region, in its order, each node meets its neighbours, those with the longest common prefix first, and two
   nodes whose sketches agree in as many places as ``agree`` asks are joined; nodes that are joined already needn't meet. Joined nodes
   are groups.
5. Links. Groups are compared on their full sets (``prefix_join.linked_sets``), so every link is exact and none within
   a group is missed.

What may be missed: a pair at the least similarity of 0.8 stands in one region of a tree with probability 0.64 (0.56, 0.51 and 0.49 after
one to three cuts), in none of 24 with 2e-11 (3e-9 to 1e-7), and agrees in fewer places than are asked with 1e-11; more similar
pairs far less.

Defined results: a null or empty text, or one without words, has no shingles and no links; a text of fewer words than a
shingle has one, all of it; repeated rows link with each other; a null id counts as smaller than all others; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.prefix_join import JoinSetting, labels, linked_sets, node_ids, shingle_sets
from papyra.llm.shared import Stored, join_with_hubs, ordered_key, plain, release, small_batches, text_slices
from papyra.llm.word_hashes import mix

HASHES = 128
TREES = 24
#: Minima by which a tree's regions are told apart at first; further minima of a cut, and how many sequences of them.
DEPTH, STEP, BRANCHES = 2, 2, 2
#: Nodes of a region that are compared in one task; more are cut, and cuts follow while the comparisons fall to this part.
REGION = 2048
GAIN = 0.7
#: Cuts of a region one after another, at most; beyond, blocks are compared.
CUTS = 5
#: Standard deviations below their mean that the agreeing places of the least similar pairs may lie (70 of 128 at 0.8).
DEVIATIONS = 7.15
#: Rows of small regions that one task gets.
TASK_ROWS = 20_000

SETTING = JoinSetting(words=4, num=80, den=100)
FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def agree(s: JoinSetting) -> int:
    """Places of two sketches that must agree."""
    t = s.num / s.den
    return int(HASHES * t - DEVIATIONS * (HASHES * t * (1 - t)) ** 0.5)


def signatures(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of HASHES minima (32 bits each) for each set that isn't empty, in order."""
    filled = sizes[sizes > 0]
    out = np.zeros((len(filled), HASHES), np.uint32)
    if len(filled):
        starts = np.cumsum(filled) - filled
        for i, factor in enumerate(FACTORS):
            out[:, i] = np.minimum.reduceat(values * factor, starts) >> np.uint64(32)
    return out


def region_keys(signature: np.ndarray, before: np.ndarray, first: np.ndarray, minima: int) -> np.ndarray:
    """Keys of regions: the key of the region before and ``minima`` minima from place ``first`` on, for each row."""
    key = before.astype(np.uint64)
    for i in range(minima):
        value = np.take_along_axis(signature, ((first + i) % HASHES)[:, None], 1)[:, 0]
        key = mix(key * np.uint64(0xD1342543DE82EF95) + value.astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


NODES = "doc_id bigint, mark bigint, n_shingles bigint, node bigint, signature binary, sketch binary"


def _nodes(s: JoinSetting):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in text_slices(batch):
                values, sizes = shingle_sets(cut.column("text"), s)
                found, rows = signatures(values, sizes), iter(range(len(sizes)))
                of = [next(rows) if n else None for n in sizes]
                whole = pa.array([None if i is None else found[i].tobytes() for i in of], pa.binary())
                low = pa.array([None if i is None else found[i].astype(np.uint8).tobytes() for i in of], pa.binary())
                node = pa.array(node_ids(values, sizes), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("mark"), pa.array(sizes.astype(np.int64)), node, whole, low], names=["doc_id", "mark", "n_shingles", "node", "signature", "sketch"])

    return run


def _bytes(column: pa.Array, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The region of each node in each tree."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        signature = _bytes(batch.column("signature"), np.uint32, n)
        tree = np.repeat(np.arange(TREES), n)
        key = region_keys(np.tile(signature, (TREES, 1)), tree, DEPTH * tree, DEPTH)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tree.astype(np.int32)), pa.array(np.tile(np.asarray(batch.column("node")), TREES))], names=["region", "tree", "node"])


def _parts(cut: int):
    """The parts that a further cut makes of a region, one row for each sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            signature, tree, region = _bytes(batch.column("signature"), np.uint32, n), np.asarray(batch.column("tree")), np.asarray(batch.column("region")).view(np.uint64)
            for b in range(BRANCHES):
                first = DEPTH * tree.astype(np.int64) + DEPTH + STEP * (BRANCHES * cut + b)
                key = region_keys(signature, region + np.uint64(b), first, STEP)
                yield pa.RecordBatch.from_arrays([batch.column("region"), pa.array(key), batch.column("tree"), batch.column("node")], names=["before", "region", "tree", "node"])

    return run


def neighbours(region: np.ndarray, tree: np.ndarray, node: np.ndarray, sketch: np.ndarray, side: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Pairs that join all nodes of like sketches within each region; of two sides, only across."""
    n = len(region)
    places = (DEPTH * tree[:, None] + np.arange(16)) % HASHES
    turned = np.ascontiguousarray(np.take_along_axis(sketch, places, 1)).view(">u8")
    order = np.lexsort((node, turned[:, 1], turned[:, 0], region))
    region, node, sketch, side = region[order], node[order], sketch[order], side[order]
    label, found = np.arange(n), []
    ends = np.flatnonzero(np.append(region[1:] != region[:-1], True)) + 1 if n else np.zeros(0, int)
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n)  # rows from here to the region's end
    mixed = bool(side.any() and not side.all())

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    at, far = np.flatnonzero(left > 1), 1
    while len(at):
        i, joined = at[label[at] != label[at + far]], False
        if mixed:
            i = i[side[i] != side[i + far]]
        for step in range(0, len(i), 1 << 16):
            part = i[step : step + (1 << 16)]
            like = part[(sketch[part] == sketch[part + far]).sum(1) >= least]
            for x in like:
                a, b = root(int(x)), root(int(x) + far)
                if a != b:
                    label[max(a, b)] = min(a, b)
                    found.append((int(node[x]), int(node[x + far])))
                    joined = True
        while joined and not np.array_equal(after := label[label], label):
            label[:] = after
        far += 1
        at = at[left[at] > far]
    return found


def _neighbours(least: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        column = lambda c: np.asarray(t.column(c))
        pairs = neighbours(column("region"), column("tree").astype(np.int64), column("node"), _bytes(t.column("sketch"), np.uint8, t.num_rows), column("side"), least)
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def regions(chosen: Stored) -> DataFrame:
    """(region, tree, node, n): regions of two nodes at least, n of them; those of more than REGION are as deep as they gain by it."""
    spark, rows = chosen.spark, Stored(chosen.read().select("node", "signature").mapInArrow(_roots, "region bigint, tree int, node bigint"), "forest")
    done: list[Stored] = []
    counts = Stored(rows.read().groupBy("region").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n")), "regions")
    met = Stored(join_with_hubs(rows.read(), counts.read(), "region", "n").select("region", "tree", "node", F.col("size").alias("n")), "regions-met")
    release(spark, rows, counts)
    for cut in range(CUTS):
        done.append(met)
        large = met.read().where(F.col("n") > REGION)
        if large.isEmpty():
            break
        parts = Stored(large.join(chosen.read().select("node", "signature"), "node").mapInArrow(_parts(cut), "before bigint, region bigint, tree int, node bigint"), "parts")
        sizes = Stored(parts.read().groupBy("before", "region").agg(F.count("*").alias("n")), "part-sizes")
        # a region is cut if that leaves few enough comparisons
        gains = sizes.read().groupBy("before").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("after"), (F.sum("n") / BRANCHES).alias("whole"))
        gains = Stored(gains.select(F.col("before").alias("region"), (F.col("after") <= GAIN * F.col("whole") * F.col("whole")).alias("cut"), F.col("whole").cast("bigint").alias("n")), "gains")
        uncut = join_with_hubs(large.withColumnRenamed("n", "size"), gains.read(), "region", "n").where("not cut").select("region", "tree", "node", F.col("size").alias("n"))
        kept = Stored(met.read().where(F.col("n") <= REGION).unionByName(uncut), "regions-kept")
        wanted = sizes.read().join(gains.read().where("cut").select(F.col("region").alias("before")), "before").where("n > 1").select("region", "n", F.col("n").alias("size"))
        below = Stored(join_with_hubs(parts.read().select("region", "tree", "node"), wanted, "region", "n").select("region", "tree", "node", F.col("size").alias("n")), "regions-cut")
        done[-1] = kept
        release(spark, met, parts, sizes, gains)
        met = below
        if met.read().isEmpty():
            break
    else:
        done.append(met)
    return reduce(DataFrame.union, [d.read() for d in done])


def candidate_links(chosen: Stored, s: JoinSetting) -> Stored:
    """(a, b): joined nodes, from nodes with signatures and sketches."""
    spark = chosen.spark
    rows = Stored(regions(chosen).join(chosen.read().select("node", "sketch"), "node"), "forest-rows")
    release(spark)
    tasks = max(8, rows.read().count() // TASK_ROWS)
    blocks = F.when(F.col("n") > REGION, F.ceil(2 * F.col("n") / REGION)).otherwise(1).cast("int")
    cut = rows.read().withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    small = F.col("blocks") == 1
    cut = cut.select(
        "region", "tree", "node", "sketch", F.when(small, F.pmod(F.xxhash64("region"), F.lit(tasks))).otherwise(F.col("region")).alias("task"), small.alias("small"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    edges = Stored(cut.groupBy("task", "small", "i", "j").applyInArrow(_neighbours(agree(s)), "a bigint, b bigint").distinct(), "candidates")
    release(spark, rows)
    return edges


def near_duplicates(docs: DataFrame, s: JoinSetting = SETTING) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (whether that is the row's own) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = plain(docs, ("doc_id", "text")).withColumn("mark", F.xxhash64("text"))
    nodes = Stored(texts.mapInArrow(_nodes(s), NODES), "nodes")
    table = nodes.read().drop("signature", "sketch")
    known = table.where("node is not null").withColumn("d", ordered_key("doc_id"))
    same = nodes.read().where("node is not null").withColumn("d", ordered_key("doc_id")).groupBy("node")  # all rows of a node have one signature
    chosen = Stored(same.agg(F.min(F.struct("d", "mark")).alias("r"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")).select("r.d", "r.mark", "node", "signature", "sketch"), "chosen")
    release(spark)
    edges = candidate_links(chosen, s)
    keyed = texts.withColumn("d", ordered_key("doc_id"))
    found = labels(table, known, chosen, linked_sets(keyed, chosen, edges.read(), s))
    component = F.when(F.col("first") > -(1 << 63), F.col("first"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
