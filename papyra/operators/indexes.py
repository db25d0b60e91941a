"""Approximate vector indexes as stored tables (IR-04, SRC-19): inverted lists by centroid, and a neighbour graph.

Both index every row; only the centroids may be fitted on a part of the rows (``sample``). Recall against the exact scan is
measured by ``recall``. Rows whose vector is null or of length zero have no direction and are left out of cosine indexes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.operators.vectors import BLOCK, HITS, best_rows, measure
from papyra.session import shared_folder

def _vectors(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def prepared(df: DataFrame, metric: str, id_col: str, vector: str) -> DataFrame:
    """(id, v): doubles, of length one for cosine."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    if metric != "cosine":
        return rows
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("_l", length).where("_l > 0").select("id", F.transform("v", lambda x: x / F.col("_l")).alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray, metric: str, k: int = 1) -> np.ndarray:
    """Numbers of the k nearest centroids of each vector, nearest first."""
    s = measure(v, centroids, "l2") if metric == "l2" else -(v @ centroids.T)
    if k == 1:
        return s.argmin(1)[:, None]
    return np.argsort(s, axis=1, kind="stable")[:, :k]


def fit_centroids(rows: DataFrame, lists: int, metric: str, rounds: int = 6) -> np.ndarray:
    """Lloyd's rounds: each is one pass, and ``lists`` times the dimensions numbers reach the driver; an empty list keeps its centroid."""
    first = rows.orderBy(F.xxhash64(F.lit("centroid"), "id"), "id").limit(lists).collect()
    centroids = np.array([r["v"] for r in first], np.float64)
    for _ in range(rounds if len(first) else 0):

        def sums(batches: Iterator[pa.RecordBatch], c: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
            for b in batches:
                if b.num_rows:
                    v = _vectors(b.column("v"), b.num_rows)
                    own = nearest(v, c, metric)[:, 0]
                    np.add.at(total, own, v)
                    count += np.bincount(own, minlength=len(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(count), pa.array(list(total))], names=["list", "n", "total"])

        part = rows.select("v").mapInArrow(sums, "list bigint, n bigint, total array<double>")
        each = part.select("list", "n", F.posexplode("total").alias("i", "x")).groupBy("list", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for r in each.collect():
            if r["n"]:
                centroids[r["list"], r["i"]] = r["x"] / r["n"]
        if metric == "cosine":
            length = np.linalg.norm(centroids, axis=1, keepdims=True)
            centroids = centroids / np.where(length > 0, length, 1)
    return centroids


@dataclass
class ListIndex:
    """Inverted lists: a folder of vectors partitioned by list, and another of the centroids."""

    spark: SparkSession
    path: str
    metric: str
    centroids: np.ndarray
    sizes: dict[int, int]

    @staticmethod
    def build(df: DataFrame, path: str, lists: int = 100, metric: str = "cosine", sample: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> ListIndex:
        """``sample``: rows that centroids are fitted on, about (smallest hashes of ids); all rows are indexed."""
        spark, rows = df.sparkSession, prepared(df, metric, id_col, vector)
        fitted = rows
        if sample is not None and (n := rows.count()) > sample:
            fitted = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < sample)
        centroids = fit_centroids(fitted, lists, metric)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = nearest(_vectors(b.column("v"), b.num_rows), centroids, metric)[:, 0] if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=["id", "v", "list"])

        placed = rows.mapInArrow(assign, "id bigint, v array<double>, list int") if len(centroids) else rows.withColumn("list", F.lit(0))
        # a long list goes to several tasks
        placed.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{path}/lists")
        spark.createDataFrame([(i, c.tolist(), metric) for i, c in enumerate(centroids)], "list int, centroid array<double>, metric string").coalesce(1).write.parquet(f"{path}/centroids")
        return ListIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ListIndex:
        found = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        lists = spark.read.schema("id bigint, v array<double>, list int").parquet(f"{path}/lists")
        sizes = {r["list"]: r["n"] for r in lists.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
        return ListIndex(spark, path, found[0]["metric"] if found else "cosine", np.array([r["centroid"] for r in found], np.float64), sizes)

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """The stored vectors; of the named lists only their files are read."""
        df = self.spark.read.schema("id bigint, v array<double>, list int").parquet(f"{self.path}/lists")
        return df if lists is None else df.where(F.col("list").isin(lists))

    def search(self, queries: DataFrame, k: int, probes: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, rank, id, score: the k best rows of each query's ``probes`` nearest lists, the query's own id apart; with all lists probed the exact answer."""
        asked, centroids, metric, probes = prepared(queries, self.metric, id_col, vector), self.centroids, self.metric, min(probes, len(self.centroids))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = nearest(_vectors(b.column("v"), b.num_rows), centroids, metric, probes) if b.num_rows else np.zeros((0, 1), int)
                at = np.repeat(np.arange(b.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([c.take(pa.array(at)) for c in b.columns] + [pa.array(near.ravel().astype(np.int32))], names=["id", "v", "list"])

        if not probes:
            return self.spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
        met = asked.mapInArrow(probe, "id bigint, v array<double>, list int")
        counted = {r["list"]: r["n"] for r in met.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
        wanted = [x for x in counted if x in self.sizes]
        # a pair of blocks of a list's queries and rows in one task
        q_blocks = self._blocks({x: counted[x] for x in wanted})
        c_blocks = self._blocks({x: self.sizes[x] for x in wanted})
        own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        a = met.where(F.col("list").isin(wanted)).select("id", "v", "list", own(q_blocks).alias("qb"), every(c_blocks).alias("cb"))
        b = self.rows(wanted).select("id", "v", "list", own(c_blocks).alias("cb"), every(q_blocks).alias("qb"))

        def best(q: pa.Table, c: pa.Table) -> pa.Table:
            if not q.num_rows or not c.num_rows:
                return HITS.empty_table()
            found = best_rows(_vectors(q.column("v"), q.num_rows), np.asarray(q.column("id")), _vectors(c.column("v"), c.num_rows), np.asarray(c.column("id")), k, metric if metric == "l2" else "inner_product")
            return pa.table(list(found), schema=HITS)

        found = a.groupBy("list", "qb", "cb").cogroup(b.groupBy("list", "qb", "cb")).applyInArrow(best, "query_id bigint, id bigint, score double")
        return ranked(found, k, metric)

    def probes_for(self, queries: DataFrame, k: int, target: float, id_col: str = "vec_id", vector: str = "embedding") -> int:
        """The fewest probes that find ``target`` of the exact hits of these queries, a sample: the lists of their exact hits say how many."""
        every = len(self.centroids)
        exact = self.search(queries, k, every, id_col, vector)
        held = self.rows().select("id", "list")
        asked = prepared(queries, self.metric, id_col, vector).withColumnRenamed("id", "query_id")
        hits = exact.select("query_id", "id").join(held, "id").groupBy("query_id").agg(F.collect_list("list").alias("lists"))  # k rows of a query
        centroids, metric = self.centroids, self.metric

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = nearest(_vectors(b.column("v"), b.num_rows), centroids, metric, every)
                    place = np.argsort(near, axis=1)
                    lists = b.column("lists").to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([place[i][x] + 1 for i, x in enumerate(lists)]).astype(np.int32))], names=["probes"])

        found = asked.join(hits, "query_id").select("v", "lists").mapInArrow(places, "probes int").groupBy("probes").count().orderBy("probes").collect()  # a row for each list at most
        total, held_by = sum(r["count"] for r in found), 0
        for r in found:
            held_by += r["count"]
            if held_by >= target * total:
                return r["probes"]
        return every

    @staticmethod
    def _blocks(sizes: dict[int, int]):
        large = [(x, -(-n // BLOCK)) for x, n in sizes.items() if n > BLOCK]
        out = F.lit(1)
        for x, n in large:
            out = F.when(F.col("list") == x, n).otherwise(out)
        return out


def ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.asc("score") if metric == "l2" else F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Part of the exact hits that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0


#: Of the neighbour graph: rows for each centroid, regions of a row, rows of a region that are compared with each other, arbitrary links of a row, centroids at most.
SHARE, OVERLAP, REGION, FAR, CENTROIDS = 512, 8, 8192, 2, 4096


def regions(rows: DataFrame, n: int, metric: str) -> DataFrame:
    """(id, v, list, part): each row in its ``OVERLAP`` nearest lists; a list of more than ``REGION`` rows is dealt into parts."""
    lists = min(CENTROIDS, -(-n // SHARE))
    if lists <= OVERLAP and n <= REGION:  # all rows meet
        return rows.withColumns({"list": F.lit(0), "part": F.lit(0)})
    fitted = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < 16 * lists)
    centroids = fit_centroids(fitted, lists, metric, 3)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                near = nearest(_vectors(b.column("v"), b.num_rows), centroids, metric, OVERLAP)
                take = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([c.take(take) for c in b.columns] + [pa.array(near.ravel().astype(np.int32))], names=["id", "v", "list"])

    placed = rows.mapInArrow(assign, "id bigint, v array<double>, list int")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / REGION).alias("parts"))  # a row for each list
    return placed.join(F.broadcast(sizes), "list").select("id", "v", "list", F.pmod(F.xxhash64("list", "id"), F.col("parts")).cast("int").alias("part"))


def _region_links(degree: int, metric: str):
    """Each row's ``degree`` nearest of a part of a region."""

    def run(t: pa.Table) -> pa.Table:
        v, ids = _vectors(t.column("v"), t.num_rows), np.asarray(t.column("id"))
        return pa.table(list(best_rows(v, ids, v, ids, degree, metric if metric == "l2" else "inner_product")), names=["a", "b", "score"])

    return run


EDGES = "a bigint, b bigint, score double, new boolean"


def _local_pairs(metric: str, keep: int):
    """Pairs among each node's neighbours with a new one among them, scored; of a task's pairs each node's ``keep`` best."""
    sign = -1.0 if metric == "l2" else 1.0

    def run(t: pa.Table) -> pa.Table:
        node, other, new = (np.asarray(t.column(c)) for c in ("node", "other", "new"))
        v = _vectors(t.column("v"), t.num_rows)
        order = np.lexsort((other, node))
        node, other, new, v = node[order], other[order], new[order], v[order]
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        out = []
        for a, b in zip(starts, np.append(starts[1:], len(node))):
            i, j = np.triu_indices(b - a, 1)
            some = (new[a:b][i] | new[a:b][j]) & (other[a:b][i] != other[a:b][j])
            i, j = i[some] + a, j[some] + a
            s = -np.sqrt(((v[i] - v[j]) ** 2).sum(1)) if metric == "l2" else (v[i] * v[j]).sum(1)
            out += [(other[i], other[j], s), (other[j], other[i], s)]
        if not out:
            return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())], names=["a", "b", "score"])
        x, y, s = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((y, -s, x))
        x, y, s = x[order], y[order], s[order]
        one = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (s[1:] != s[:-1]))
        x, y, s = x[one], y[one], s[one]
        begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        place = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
        best = place < keep
        return pa.table([x[best], y[best], sign * s[best]], names=["a", "b", "score"])

    return run


@dataclass
class GraphIndex:
    """Neighbour graph: a folder of vectors, one of links (a, b), and one of entry points."""

    spark: SparkSession
    path: str
    metric: str

    @staticmethod
    def build(df: DataFrame, path: str, degree: int = 32, metric: str = "cosine", rounds: int = 0, settled: float = 0.002, id_col: str = "vec_id", vector: str = "embedding") -> GraphIndex:
        """Each row is in its ``OVERLAP`` nearest of many regions; of all rows of its regions the ``degree`` nearest are its links, and ``FAR`` arbitrary ones.

        Centroids of regions are fitted on 16 rows for each (smallest hashes of ids); every row is indexed. A region of more than ``REGION`` rows is dealt by hash into parts of that size, each
        compared with itself, so a row meets at most OVERLAP * REGION others however many there are; recall is measured by tests.
        With ``rounds``, neighbour-graph descent follows: neighbours of a node are compared with each other and everyone keeps its best.
        A round compares at most (2 * degree)² / 2 pairs for each node: of the links that lead to a node, those of ``degree`` smallest hashes
        take part, so a node that many others link to costs no more. Rounds end when fewer than ``settled`` of the links change.
        """
        spark = df.sparkSession
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
        prepared(df, metric, id_col, vector).write.parquet(f"{path}/vectors")
        rows = spark.read.parquet(f"{path}/vectors")
        n = rows.count()
        tasks = max(1, n * 2 * degree // 100_000)
        better = F.asc("score") if metric == "l2" else F.desc("score")
        w = Window.partitionBy("a").orderBy(better, "b")
        met = regions(rows, n, metric).groupBy("list", "part").applyInArrow(_region_links(degree, metric), "a bigint, b bigint, score double")
        links = met.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= degree).drop("r").withColumn("new", F.lit(True)).checkpoint()
        for step in range(rounds):
            back = links.select(F.col("b").alias("node"), F.col("a").alias("other"), "new")
            back = back.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("new"), F.xxhash64(F.lit(step), "other")))).where(F.col("r") <= degree).drop("r")
            near = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "new").union(back).groupBy("node", "other").agg(F.max("new").alias("new"))
            selves = rows.select(F.col("id").alias("node"), F.col("id").alias("other"), F.lit(True).alias("new"))  # the node meets its neighbours too
            met = near.unionByName(selves if step == 0 else selves.withColumn("new", F.lit(False))).join(rows.withColumnRenamed("id", "other"), "other")
            pairs = met.groupBy(F.pmod(F.xxhash64("node"), F.lit(tasks)).alias("task")).applyInArrow(_local_pairs(metric, degree), "a bigint, b bigint, score double")
            held = links.where(F.abs("score") < float("inf")).withColumn("new", F.lit(False))
            both = held.select("a", "b", "score", "new").unionByName(pairs.withColumn("new", F.lit(True))).groupBy("a", "b").agg(F.min("score").alias("score") if metric == "l2" else F.max("score").alias("score"), F.min("new").alias("new"))
            best = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= degree).drop("r")
            links = best.checkpoint()
            changed = links.agg(F.avg(F.col("new").cast("double"))).first()[0]
            if changed is None or changed < settled:
                break
        # arbitrary links: all nodes in ``FAR`` hash orders, each linked to the next; an order is cut into shares, whose ends are left open
        orders = rows.select("id", F.explode(F.sequence(F.lit(1), F.lit(FAR))).alias("o")).withColumn("h", F.xxhash64("o", "id"))
        share = F.pmod(F.shiftright("h", 40), F.lit(1 + n // 50_000))
        far = orders.withColumn("b", F.lead("id").over(Window.partitionBy("o", share).orderBy("h", "id"))).where("b is not null and b <> id").select(F.col("id").alias("a"), "b")
        # links go both ways, so that nodes nobody links to are reached
        links = links.select("a", "b").union(far)
        either = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        either.repartition("a").sortWithinPartitions("a").write.parquet(f"{path}/links")
        spark.createDataFrame([(metric,)], "metric string").coalesce(1).write.parquet(f"{path}/kind")
        return GraphIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> GraphIndex:
        return GraphIndex(spark, path, spark.read.parquet(f"{path}/kind").first()["metric"])

    def search(self, queries: DataFrame, k: int, beam: int = 64, entries: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, rank, id, score: beam search of all queries at once.

        A query begins at the best of ``entries`` fixed rows. In each round the rows of its beam that are not yet opened are; their links that
        it has not seen are scored, and the ``beam`` best of all seen are the next beam. It ends when all of the beam is opened.
        """
        spark, metric = self.spark, self.metric
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
        rows, links = spark.read.parquet(f"{self.path}/vectors"), spark.read.parquet(f"{self.path}/links")
        asked = prepared(queries, metric, id_col, vector).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        zipped = lambda f: F.aggregate(F.zip_with("q", "v", f), F.lit(0.0), lambda s, x: s + x)
        score = F.sqrt(zipped(lambda x, y: (x - y) * (x - y))) if metric == "l2" else zipped(lambda x, y: x * y)
        better = F.asc("score") if metric == "l2" else F.desc("score")
        first = rows.orderBy(F.xxhash64(F.lit("entry"), "id"), "id").limit(entries)  # ``entries`` rows
        seen = asked.crossJoin(F.broadcast(first)).select("query_id", "id", score.alias("score"), F.lit(False).alias("opened")).checkpoint()
        while True:
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(better, "id"))
            placed = seen.withColumn("place", place)
            front = placed.where((F.col("place") <= beam) & ~F.col("opened")).select("query_id", "id")
            if front.isEmpty():
                break
            reached = front.join(links.withColumnRenamed("a", "id"), "id").select("query_id", F.col("b").alias("id")).distinct().join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")
            scored = reached.join(rows, "id").join(asked, "query_id").select("query_id", "id", score.alias("score"), F.lit(False).alias("opened"))
            before = placed.select("query_id", "id", "score", (F.col("opened") | (F.col("place") <= beam)).alias("opened"))
            seen = before.unionByName(scored).checkpoint()
        return ranked(seen.where("query_id <> id"), k, metric)
