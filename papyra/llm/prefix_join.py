"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Two documents link if the Jaccard similarity of their shingle sets is at least num/den. Documents with equal sets are
one node, known by a hash of the set, and one of them stands for all: everything below is about nodes.

1. Order. All shingles are ordered from rare to frequent. Frequencies are counted over all documents in a table of fixed
   size (``Frequencies``: two rows of counters, the smaller counts); it is an estimate, and any order is right as long as it
   is one order, ties by hash. What many documents share comes last.
2. Prefixes. A linked set of n shingles shares needed(n) = ceil(n * num / den) of them at least, so of two linked sets the
   first n - needed(n) + l shingles of each share l at least. Every node picks its own l: from a least value for its size
   it is doubled as long as that lowers the estimated cost, the rows that its prefix shingles bring plus the comparisons
   that are left if l of them must match. Costly nodes get longer prefixes and must match more. A pair must share the
   smaller l of both.
3. Pairs. Lists of a shingle with ``COMMON`` nodes at most are paired and matches are counted. Longer lists are not
   paired: their nodes, if they have so many such shingles that a pair could go without any match in a short list, are
   linked to the first node of the list that is of like size, n rows by n - 1 links. A pair counted in short lists is granted as many
   matches in long ones as the node with fewer long lists has. Candidate groups are components of both kinds of links.
4. Verification. In a group, sets are cut to cells (the shingles of a set are spread over D + l cells by hash; sets that
   differ in D shingles have l equal cells), l growing with the number of candidates, and only pairs with l equal cells
   are compared, unless links join them already. Large groups are cut into blocks; a task gets two blocks.
5. Links found are a spanning set; their components are the answer.

No candidate is dropped: the filters are necessary conditions of a link. (If a linked pair has no match in a short list,
both have at least the smaller l of both in long lists; that node is one that starts a chain in each of them, and the
other one joins it, as it has as many.) Defined results: a null or empty text, or one without words, has an empty set and
no links; a text of fewer words than a shingle has one shingle, all of it; repeated rows link with each other; a null id
counts as smaller than all others; an empty table gives an empty table; other columns are ignored by ``linked`` and
passed through by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.shared import Stored, components, in_slice, join_with_hubs, ordered_key, plain, release, small_batches, stored_in_slices, text_buffer, text_slices
from papyra.llm.word_hashes import LOWER, Words, mix, run_hashes

#: Nodes of a shingle beyond which its list is long.
COMMON = 16
#: The least l: this part of n - needed(n), and LEAST_NEED at least; and by what it may be multiplied.
NEED_PART = 2
LEAST_NEED = 3
FACTORS = (1, 2, 4, 8)
#: Cost of comparing two nodes, in rows of a list.
COMPARE = 24
#: Counters of each of the two rows of the table of frequencies.
COUNTERS = 1 << 20
#: Rows of one shingle that one task joins, about.
SPLIT = 1024
#: Nodes of a block, and of the small groups that one task gets.
BLOCK = 512
TASK_NODES = 2000
#: Prefix rows, texts and sets that are shuffled at a time, about, so that disk holds a part of their shuffle files; texts are read once for each slice, so often at most.
SLICE_ROWS, SLICE_TEXTS, SLICE_SETS, TEXT_SLICES = 1 << 22, 1 << 16, 1 << 18, 8


@dataclass(frozen=True)
class JoinSetting:
    words: int = 3
    num: int = 90
    den: int = 100
    lower: bool = True

    def bounds(self, most: int) -> np.ndarray:
        """Lower ends of the size classes, to two classes beyond ``most``."""
        out = [1]
        while len(out) < 4 or out[-3] <= most:
            out.append(max(out[-1] + 1, out[-1] * self.den // self.num + 1))
        return np.asarray(out)

    def differ(self, bounds: np.ndarray, c: np.ndarray) -> np.ndarray:
        """D of scheme c: a pair's smaller set is of class c, the larger of class c or c + 1."""
        return (bounds[c + 1] + bounds[c + 2] - 2) * (self.den - self.num) // (self.den + self.num)

    def needed(self, n: np.ndarray) -> np.ndarray:
        """Shingles that a set of n must share with any that it links with."""
        return -(-self.num * n // self.den)

    def links(self, a: int, b: int, both: int) -> bool:
        return self.den * both >= self.num * (a + b - both)


def shingle_sets(texts: pa.Array, s: JoinSetting) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and how many each text has."""
    raw, offsets = text_buffer(texts)
    words = Words(LOWER[raw] if s.lower else raw, offsets)
    h = words.hashes()
    grams = run_hashes(h, s.words)
    inside = np.flatnonzero(words.doc[: len(grams)] == words.doc[s.words - 1 :][: len(grams)])
    doc, value = words.doc[inside], grams[inside]
    short = np.flatnonzero((words.count > 0) & (words.count < s.words))
    if len(short):
        whole = np.asarray([run_hashes(h[words.first[i] : words.first[i] + words.count[i]], int(words.count[i]))[0] + np.uint64(words.count[i]) for i in short], np.uint64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, whole])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=len(texts))


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sum of 64-bit hashes at each index, modulo 2^64 (halves are summed exactly as doubles)."""
    low = np.bincount(index, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), size).astype(np.uint64)
    high = np.bincount(index, (values >> np.uint64(32)).astype(np.float64), size).astype(np.uint64)
    return low + (high << np.uint64(32))


def node_ids(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each set."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return mix(_sums(doc, mix(values), len(sizes)) + sizes.astype(np.uint64)).view(np.int64)


def cells(values: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every cell's shingles (0: empty) and its number, ``counts`` cells for each set one after another."""
    begin = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(sizes)), sizes)
    cell = (mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % counts.astype(np.uint64)[doc]).astype(np.int64)
    total = int(counts.sum())
    number = np.arange(total) - np.repeat(begin, counts)
    return _sums(begin[doc] + cell, mix(values + np.uint64(0x632BE59BD9B4E019)), total), number


class Frequencies:
    """Counts of shingles in a table of fixed size: two rows of counters, each shingle has one in each; the smaller one stands."""

    def __init__(self, counts: np.ndarray | None = None):
        self.counts = np.zeros((2, COUNTERS), np.int64) if counts is None else counts

    @staticmethod
    def _places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (values % np.uint64(COUNTERS)).astype(np.int64), ((values >> np.uint64(40)) % np.uint64(COUNTERS)).astype(np.int64)

    def add(self, values: np.ndarray) -> None:
        for row, at in zip(self.counts, self._places(values)):
            row += np.bincount(at, minlength=COUNTERS)

    def pack(self) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress(np.minimum(self.counts, 2**32 - 1).astype("<u4").tobytes())

    def merge(self, data: bytes) -> None:
        import zstandard

        self.counts += np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").reshape(2, COUNTERS)

    def of(self, values: np.ndarray) -> np.ndarray:
        """Estimated number of documents with each shingle, 1 at least; what an average counter holds of others is taken off."""
        a, b = self._places(values)
        others = int(2 * self.counts[0].sum() // COUNTERS)
        return np.maximum(1, np.minimum(self.counts[0][a], self.counts[1][b]) - others)


def least_need(sizes: np.ndarray, s: JoinSetting) -> np.ndarray:
    """The l that a set of this size picks at least; it doesn't fall with the size."""
    needed = s.needed(sizes)
    return np.minimum(needed, np.maximum(LEAST_NEED, (sizes - needed) // NEED_PART))


def prefix_tokens(values: np.ndarray, sizes: np.ndarray, s: JoinSetting, frequencies: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, set, l, estimated frequency) of the prefix of each set."""
    doc, often = np.repeat(np.arange(len(sizes)), sizes), frequencies.of(values)
    order = np.lexsort((values, often, doc))
    values, often = values[order], often[order]
    begin = np.cumsum(sizes) - sizes
    needed = s.needed(sizes)
    free, least = sizes - needed, least_need(sizes, s)
    rows = np.append(0, np.cumsum(often - 1)).astype(np.float64)
    need, best = least.copy(), np.full(len(sizes), np.inf)
    for factor in FACTORS:
        l = np.minimum(needed, least * factor)
        scan = rows[begin + free + l] - rows[begin]
        cost = scan + COMPARE * scan / np.maximum(l, 1)
        need, best = np.where(cost < best, l, need), np.minimum(cost, best)
    place = np.arange(len(values)) - begin[doc]
    sent = place < (free + need)[doc]
    return values[sent], doc[sent], need[doc[sent]], often[sent]


NODE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("counts", pa.binary())])
NODES = "doc_id bigint, mark bigint, n_shingles bigint, node bigint, counts binary"


def _nodes(s: JoinSetting):
    """A row for each document, and one row with the counts of all shingles that the task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Frequencies()
        for batch in batches:
            for cut in text_slices(batch):
                values, sizes = shingle_sets(cut.column("text"), s)
                seen.add(values)
                node = pa.array(node_ids(values, sizes), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("mark"), pa.array(sizes.astype(np.int64)), node, pa.nulls(len(sizes), pa.binary())], schema=NODE_SCHEMA)
        yield pa.RecordBatch.from_pylist([{"counts": seen.pack()}], schema=NODE_SCHEMA)

    return run


def _merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = Frequencies()
    for batch in batches:
        for data in batch.column("counts"):
            total.merge(data.as_py())
    yield pa.RecordBatch.from_pylist([{"counts": total.pack()}], schema=pa.schema([("counts", pa.binary())]))


def frequencies(nodes: DataFrame) -> Frequencies:
    """One table from those of all tasks; at most 8 of them reach the driver, whatever the corpus."""
    counts = nodes.where("counts is not null").select("counts")
    parts = counts.count()
    while parts > 8:
        parts = max(8, parts // 32)
        counts = Stored(counts.repartition(parts).mapInArrow(_merge_counts, "counts binary"), "counts").read()
    total = Frequencies()
    for row in counts.collect():
        total.merge(row[0])
    return total


TOKENS = "token bigint, node bigint, size int, class int, need int, low int, splits int"


def _prefixes(s: JoinSetting, table):
    """Prefix shingles of each text. ``low``: the least l of any set that it may link with; ``splits``, the same for every row of a shingle, is the number of tasks that should share them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Frequencies(table.value)
        for batch in batches:
            for cut in text_slices(batch):
                values, sizes = shingle_sets(cut.column("text"), s)
                node = node_ids(values, sizes)
                single = np.zeros(len(sizes), bool)
                single[np.unique(node, return_index=True)[1]] = True  # repeated rows
                values, sizes, node = values[np.repeat(single, sizes)], sizes[single], node[single]
                token, owner, need, often = prefix_tokens(values, sizes, s, known)
                own = np.searchsorted(s.bounds(int(sizes.max(initial=1))), sizes, side="right") - 1
                columns = [pa.array(token.view(np.int64)), pa.array(node[owner]), *(pa.array(x.astype(np.int32)) for x in (sizes[owner], own[owner], need, least_need(s.needed(sizes), s)[owner])), pa.array((1 + often // SPLIT).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "node", "size", "class", "need", "low", "splits"])

    return run


def _sets(s: JoinSetting):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in text_slices(batch):
                values, sizes = shingle_sets(cut.column("text"), s)
                found = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), values.view(np.int64))
                yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in ("root", "node", "group_nodes")), found], names=["root", "node", "group_nodes", "shingles"])

    return run


def spanning_links(sets: list[np.ndarray], nodes: np.ndarray, side: np.ndarray, s: JoinSetting) -> list[tuple[int, int]]:
    """Links that join all linked sets of a group; ``side`` is 0 or 1, and with both present only pairs across are compared."""
    sizes = np.asarray([len(x) for x in sets])
    across, label, found = bool(side.any() and not side.all()), np.arange(len(sets)), []
    bounds = s.bounds(int(sizes.max(initial=1)))
    own = np.searchsorted(bounds, sizes, side="right") - 1
    for c in np.unique(own):
        upper = np.flatnonzero((own == c) | (own == c + 1))
        lower = np.flatnonzero(own == c)
        if len(upper) < 2:
            continue
        need = int(min(256, max(4, len(upper) // 8)))  # l: the more candidates, the longer the prefix
        count = int(s.differ(bounds, c)) + need
        content, _ = cells(np.concatenate([sets[i] for i in upper]), sizes[upper], np.full(len(upper), count))
        table, at = content.reshape(len(upper), count), {int(i): k for k, i in enumerate(upper)}
        for i in lower:
            other = (label[upper] != label[i]) & ((own[upper] > c) | (upper > i)) & (s.den * np.minimum(sizes[upper], sizes[i]) >= s.num * np.maximum(sizes[upper], sizes[i]))
            if across:
                other &= side[upper] != side[i]
            close = np.flatnonzero(other)
            close = close[(table[close] == table[at[int(i)]]).sum(1) >= need]
            for j in upper[close]:
                if label[i] != label[j] and s.links(int(sizes[i]), int(sizes[j]), len(np.intersect1d(sets[i], sets[j], assume_unique=True))):
                    found.append((int(nodes[i]), int(nodes[j])))
                    label[label == label[j]] = label[i]
    return found


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(s: JoinSetting):
    def run(t: pa.Table) -> pa.Table:
        root = np.asarray(t.column("root"))
        order = np.lexsort((np.asarray(t.column("node")), root))
        t, root = t.take(pa.array(order)), root[order]
        shingles, node = t.column("shingles").combine_chunks(), np.asarray(t.column("node"))
        shingles = shingles.chunk(0) if isinstance(shingles, pa.ChunkedArray) else shingles
        ends = np.append(0, np.cumsum(np.asarray(shingles.value_lengths()))) if t.num_rows else np.zeros(1, int)
        values, side, out = np.asarray(shingles.flatten()).view(np.uint64), np.asarray(t.column("side")), []
        starts = np.flatnonzero(np.append(True, root[1:] != root[:-1])) if len(root) else []
        for a, b in zip(starts, np.append(starts[1:], len(root))):
            single = np.sort(np.unique(node[a:b], return_index=True)[1]) + a  # rows of one node are equal
            if len(single) > 1:
                out += spanning_links([values[ends[i] : ends[i + 1]] for i in single], node[single], side[single], s)
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))], schema=LINKS)

    return run


def _slices(rows: int, most: int, limit: int | None = None) -> int:
    slices = max(1, -(-rows // most))
    return slices if limit is None else min(limit, slices)


def candidate_links(prefixes: Stored, s: JoinSetting) -> Stored:
    """(a, b): links whose components are the candidate groups, from rows (token, node, size, class, need, low, splits)."""
    spark, slices = prefixes.spark, _slices(prefixes.read().count(), SLICE_ROWS)
    split = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("split")
    shared: list[Stored] = []

    def meeting(k: int) -> DataFrame:
        t = prefixes.read().where(in_slice(k, slices, "token"))
        release(spark, *shared)
        shared[:] = [Stored(t.groupBy("token").agg(F.count("*").alias("n"), F.max("splits").alias("splits")).where("n > 1"), "shared")]
        release(spark)
        # a shingle's rows are dealt over ``splits`` tasks, to each of which its row of ``shared`` goes
        asked = shared[0].read().select("token", "n", each(F.col("splits")))
        return t.withColumn("split", split(F.col("splits"))).join(asked, ["token", "split"]).select("token", "node", "size", "class", "need", "low", "n")

    met = stored_in_slices(meeting, slices, "met")
    release(spark, *shared)
    lists = met.read().where(F.col("n") <= COMMON).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("node", "size", "need"))).alias("l"))  # COMMON rows at most
    first = lists.select("l", F.posexplode("l").alias("i", "x")).select("x", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("y")).where("x.node <> y.node")
    first = first.where(F.least("x.size", "y.size") * s.den >= F.greatest("x.size", "y.size") * s.num)
    pairs = first.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("x.need", "y.need")).alias("need"))
    pairs = Stored(pairs, "pairs")
    release(spark)
    long = met.read().where(F.col("n") > COMMON)
    counts = Stored(long.groupBy("node").agg(F.count("*").alias("long")), "long-lists")
    count = lambda name: counts.read().select(F.col("node").alias(name), F.col("long").alias(f"long_{name}"))
    granted = pairs.read().where("shared < need").join(count("a"), "a").join(count("b"), "b").where(F.col("shared") + F.least("long_a", "long_b") >= F.col("need"))
    counted = pairs.read().where("shared >= need").select("a", "b").union(granted.select("a", "b"))

    # linked sizes share a class, or are in neighbouring ones: chains are made for each class with the next
    pieces = F.ceil(F.col("n") / SPLIT).cast("int")
    each_class = F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("scheme")
    # the smallest set that a node links with has needed(n) shingles and picks ``low`` at least: with fewer long lists than that, a pair meets in a short one
    rows = long.join(counts.read(), "node").where("long >= low").select("token", "node", "need", "n", "long", each_class).withColumn("split", split(pieces))
    rows = Stored(rows, "long-rows")
    starts = rows.read().groupBy("token", "scheme").agg(F.min(F.when(F.col("long") >= F.col("need"), F.col("need"))).alias("least"), F.max("n").alias("n")).where("least is not null")
    starts = Stored(starts.select("token", "scheme", "least", each(pieces)), "starts")
    joined = Stored(rows.read().join(starts.read(), ["token", "scheme", "split"]).where(F.col("long") >= F.least("need", "least")).select("token", "scheme", "node", "n", "split"), "joined")
    heads = joined.read().groupBy("token", "scheme").agg(F.min("node").alias("head"), F.max("n").alias("n")).select("token", "scheme", "head", each(pieces))
    chain = joined.read().join(heads, ["token", "scheme", "split"]).where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    edges = Stored(counted.union(chain).distinct(), "candidates")
    release(spark, met, pairs, counts, rows, starts, joined)
    return edges


def linked_sets(keyed: DataFrame, chosen: Stored, edges: DataFrame, s: JoinSetting) -> Stored:
    """(node, root): components of the links among nodes that candidate links ``edges`` (a, b) join into groups; a group is compared whole.

    ``keyed`` has texts by (d, mark), ``chosen`` the row of each node.
    """
    spark, slices = keyed.sparkSession, _slices(chosen.read().count(), SLICE_TEXTS, TEXT_SLICES)
    groups = Stored(components(edges), "groups")
    release(spark)

    large = Stored(groups.read().groupBy("root").agg(F.count("*").alias("group_nodes")).where(F.col("group_nodes") > BLOCK), "large-groups")  # nodes / BLOCK at most
    wanted = chosen.read().join(groups.read().join(large.read(), "root", "left"), "node")
    wanted = Stored(wanted.select("d", "mark", "node", "root", F.coalesce("group_nodes", F.lit(1).cast("long")).alias("group_nodes")), "wanted")

    def sets_of(k: int) -> DataFrame:
        # one plan at every size: a merge join, whatever the candidates' number
        part = [df.where(in_slice(k, slices, "d", "mark")) for df in (keyed, wanted.read())]
        member = part[0].join(part[1].hint("merge"), ["d", "mark"]).select("text", "root", "node", "group_nodes")
        return member.mapInArrow(_sets(s), "root bigint, node bigint, group_nodes bigint, shingles array<bigint>")

    sets = stored_in_slices(sets_of, slices, "sets")
    release(spark, groups, large, wanted)

    tasks = max(8, (sets.read().count()) // TASK_NODES)
    rows = sets.read().withColumn("blocks", F.ceil(F.col("group_nodes") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))  # a node goes to one task for each block of its group
    small = F.col("blocks") == 1
    rows = rows.select(
        "root", "node", "shingles",
        F.when(small, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.col("root")).alias("task"), small.alias("small"),
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    compared = _slices(sets.read().agg(F.sum(F.ceil(F.col("group_nodes") / BLOCK))).first()[0] or 0, SLICE_SETS)
    of_task = ["task", "small", "i", "j"]
    links = stored_in_slices(lambda k: rows.where(in_slice(k, compared, *of_task)).groupBy(*of_task).applyInArrow(_verify(s), "a bigint, b bigint"), compared, "links")
    release(spark, sets)
    roots = Stored(components(links.read()), "roots")
    release(spark, links)
    return roots


def labels(table: DataFrame, known: DataFrame, chosen: Stored, roots: Stored) -> DataFrame:
    """doc_id, d (its key), mark (hash of the text), n_shingles, root and first (smallest key of the component) of every row; no root: no links."""
    spark = table.sparkSession
    named = chosen.read().join(roots.read(), "node", "left").select("node", "d", F.coalesce("root", "node").alias("root"))
    firsts = named.groupBy("root").agg(F.min("d").alias("first"), F.count("*").alias("n"))
    named = Stored(join_with_hubs(named, firsts, "root", "n").select("node", "root", "first"), "labels")
    release(spark, chosen, roots)
    grouped = known.join(named.read(), "node").select("doc_id", "d", "mark", "n_shingles", "root", "first")
    key = ordered_key("doc_id")
    alone = table.where("node is null").select("doc_id", key.alias("d"), "mark", "n_shingles", F.lit(None).cast("bigint").alias("root"), key.alias("first"))
    return grouped.union(alone)


def _labelled(docs: DataFrame, s: JoinSetting) -> DataFrame:
    """The rows of ``labels``, from prefixes."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = plain(docs, ("doc_id", "text")).withColumn("mark", F.xxhash64("text"))
    nodes = Stored(texts.mapInArrow(_nodes(s), NODES), "nodes")
    table = nodes.read().where("n_shingles is not null").drop("counts")
    known = table.where("node is not null").withColumn("d", ordered_key("doc_id"))
    # one row of each set goes on
    chosen = Stored(known.groupBy("node").agg(F.min(F.struct("d", "mark")).alias("r")).select("r.d", "r.mark", "node"), "chosen")
    keyed = texts.withColumn("d", ordered_key("doc_id"))
    counted = spark.sparkContext.broadcast(frequencies(nodes.read()).counts)  # two rows of COUNTERS numbers
    slices = _slices(chosen.read().count(), SLICE_TEXTS, TEXT_SLICES)

    def prefixes_of(k: int) -> DataFrame:
        part = [df.where(in_slice(k, slices, "d", "mark")) for df in (keyed.where(F.length("text") > 0), chosen.read().select("d", "mark"))]
        return part[0].join(part[1], ["d", "mark"], "left_semi").select("text").mapInArrow(_prefixes(s, counted), TOKENS)

    prefixes = stored_in_slices(prefixes_of, slices, "prefixes")
    edges = candidate_links(prefixes, s)
    release(spark, prefixes)
    counted.unpersist()
    return labels(table, known, chosen, linked_sets(keyed, chosen, edges.read(), s))


def linked(docs: DataFrame, s: JoinSetting = JoinSetting()) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) of every row."""
    return _labelled(docs, s).select("doc_id", "n_shingles", F.when(F.col("first") > -(1 << 63), F.col("first")).alias("component_id"))


def one_of_each(docs: DataFrame, s: JoinSetting = JoinSetting(words=5, num=80, den=100)) -> DataFrame:
    """One row of ``docs`` for each component: of its smallest doc_id, the text of the smallest hash; of rows with equal id and text, one."""
    leaders = _labelled(docs, s).where("d = first").withColumn("own", F.when(F.col("root").isNull(), F.col("mark")))
    firsts = leaders.groupBy("root", "own", "d").agg(F.min("mark").alias("mark")).select(F.col("d").alias("_first"), F.col("mark").alias("_text")).distinct()
    kept = docs.withColumns({"_key": ordered_key("doc_id"), "_mark": F.xxhash64("text")})
    kept = kept.join(firsts, (F.col("_key") == F.col("_first")) & (F.col("_mark") == F.col("_text")), "left_semi")
    return kept.dropDuplicates(["_key", "_mark"]).drop("_key", "_mark")
