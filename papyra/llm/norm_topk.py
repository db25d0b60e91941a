"""Exact top-k inner products: vectors by descending length, partial sums in an SVD-rotated basis, Cauchy-Schwarz pruning.

Candidates are ranked by length and cut into blocks of ``candidate_block`` ranks. They are met in waves from the longest
down: the first wave is one block, each later one four times as many. After each wave a query has a k-th best score; no
candidate shorter than that score over the query's own length can reach it. So a query whose bound lies above the next
block is finished, and the others are cut into blocks by their bounds: a block of queries goes down to the block of
candidates that its lowest bound reaches, and pairs of blocks beyond are never shuffled. A task gets one pair of blocks,
so memory is fixed by the block sizes and work spreads over the pairs. Within a pair, vectors are rotated onto the singular
vectors of the block. The first coordinates give a partial sum, the rest is at most the product of the residual lengths,
and only candidates whose bound reaches a query's k-th best score are scored in full. Scores are integers and are
computed exactly; the bounds only skip work. Where all vectors are of one length, as unit vectors are, lengths prune
nothing and every pair of blocks is met.

Blocks are ranks, not partitions: the number of partitions changes neither their size nor what they return.

Defined results: a vector that is null or holds null or non-finite components takes no part, an empty one neither; vectors of
unequal size don't meet; rows with the query's own id are not its candidates; rows repeated in full count once; an empty
table gives an empty table; other columns are ignored. Ties go to the smaller id. Scaled components and scores beyond 64
bits are the nearest 64-bit number (of scores, -2^63 excepted), and so they are compared.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.shared import Stored, plain, release

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
STEP = 1024
#: Blocks of a wave for each of the wave before.
WAVE = 4
#: Relative error granted to lengths and partial sums, which are floating-point.
SLACK = 1e-6
LEAST = -(1 << 63)
MOST = (1 << 63) - 1
RESULT = "query_id bigint, vec_id bigint, score bigint"
RESULT_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x), the nearest 64-bit number where that is beyond."""
    edge = float(1 << 63)

    def one(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(y >= edge, F.lit(MOST)).when(y < -edge, F.lit(LEAST)).otherwise(F.floor(F.when((y < edge) & (y >= -edge), y)))

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(ok, F.lit(False))


def exact_scores(q: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """q times v transposed, all of 64-bit integers, no sum beyond ``most``: as doubles, as 64-bit integers, or without bounds and then cut to 64 bits."""
    if most < 2**53:
        return np.rint(q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ v.T
    return np.clip(q.astype(object) @ v.astype(object).T, LEAST + 1, MOST).astype(np.int64)


def top_of_block(ids: np.ndarray, v: np.ndarray, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's best k in the block that reach its floor; rows of v by descending length."""
    fv, fq = v.astype(np.float64), q.astype(np.float64)
    most = float(np.abs(fv).max(initial=0)) * float(np.abs(fq).max(initial=0)) * v.shape[1]
    head = max(1, v.shape[1] // 4)
    _, basis = np.linalg.eigh(fv.T @ fv)
    basis = basis[:, ::-1]
    rv, rq = fv @ basis, fq @ basis
    rest_v, rest_q = np.sqrt((rv[:, head:] ** 2).sum(1)), np.sqrt((rq[:, head:] ** 2).sum(1))
    length_v, length_q = np.sqrt((fv**2).sum(1)), np.sqrt((fq**2).sum(1))
    least, floor = floor.copy(), floor.copy()
    best_s, best_i = np.full((len(q), 0), LEAST), np.full((len(q), 0), 0)
    for a in range(0, len(v), STEP):
        b = min(len(v), a + STEP)
        slack = SLACK * (1 + length_q * length_v[a])
        live = np.flatnonzero(length_q * length_v[a] + slack >= floor)  # the longest of the step stands for all
        if not len(live):
            break  # lengths only fall from here
        bound = rq[live, :head] @ rv[a:b, :head].T + np.outer(rest_q[live], rest_v[a:b]) + slack[live, None]
        bound = np.maximum(bound, float(LEAST))  # scores are not below
        open_ = bound >= floor[live, None]
        cols, live = np.flatnonzero(open_.any(0)), live[open_.any(1)]
        if not len(cols):
            continue
        at = a + cols
        score = exact_scores(q[live], v[at], most)
        score = np.where(ids[at][None, :] == q_ids[live][:, None], LEAST, score)
        s = np.concatenate([best_s[live], score], axis=1)
        i = np.concatenate([best_i[live], np.broadcast_to(ids[at], score.shape)], axis=1)
        order = np.lexsort((i, s == LEAST, -np.maximum(s, LEAST + 1)), axis=1)[:, :k]
        if best_s.shape[1] < order.shape[1]:
            more = order.shape[1] - best_s.shape[1]
            best_s, best_i = np.pad(best_s, ((0, 0), (0, more)), constant_values=LEAST), np.pad(best_i, ((0, 0), (0, more)))
        best_s[live, : order.shape[1]], best_i[live, : order.shape[1]] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        if best_s.shape[1] >= k:
            floor[live] = np.maximum(floor[live], best_s[live, k - 1])
    row, col = np.nonzero((best_s != LEAST) & (best_s >= least[:, None]))
    return row, best_i[row, col], best_s[row, col]


def _block(k: int):
    def matrix(t: pa.Table) -> np.ndarray:
        lists = t.column("v").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        return np.asarray(lists.flatten()).reshape(t.num_rows, -1)

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return RESULT_SCHEMA.empty_table()
        ids, v, q_ids, q = np.asarray(candidates.column("vec_id")), matrix(candidates), np.asarray(queries.column("vec_id")), matrix(queries)
        order = np.lexsort((ids, -(v.astype(np.float64) ** 2).sum(1)))
        floor = np.asarray(queries.column("floor"))
        row, found, score = top_of_block(ids[order], v[order], q_ids, q, floor, k)
        return pa.table([pa.array(q_ids[row]), pa.array(found), pa.array(score)], schema=RESULT_SCHEMA)

    return run


def ranked_blocks(rows: DataFrame, size: int, *order: Column | str) -> tuple[Stored, Column, int]:
    """``rows`` stored in ``order``, their block (rank over ``size``, whatever the partitions) and their number.

    Rows are sorted by range once; a row's rank is its place in its partition and the rows of the partitions before.
    """
    spark = rows.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.shiftright(place, 33).cast("int").alias("_part"), (place % (1 << 33)).alias("_place"))
    ordered = Stored(placed, "ranked")
    counts = dict(ordered.read().groupBy("_part").agg(F.count("*")).collect())  # one number for each partition
    starts = [0]
    for part in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(part, 0))
    start = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_part"))
    return ordered, F.floor((start + F.col("_place")) / size).cast("long"), sum(counts.values())


def _reach(lengths: list[float]) -> Column:
    """How many blocks of candidates, of these longest vectors, a query of ``length`` and ``floor`` must go down."""
    step = -(-len(lengths) // 64)  # many blocks are looked at by their first of ``step``
    heads = F.array(*[F.lit(float(x)) for x in lengths[::step]])
    near = lambda x: x * F.col("length") + SLACK * (1 + x * F.col("length")) >= F.col("floor")
    return F.least(F.size(F.filter(heads, near)) * step, F.lit(len(lengths))).cast("long")


def top_inner_products(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` highest scores for every row of (vec_id, embedding) that ``queries`` picks."""
    spark = vectors.sparkSession
    rows = plain(vectors, ("vec_id", "embedding")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", scaled(F.col("embedding"), scale).alias("v")).distinct()
    rows = rows.withColumn("dim", F.size("v")).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    ranked, block, _ = ranked_blocks(rows, candidate_block, F.desc("length"), F.col("vec_id"), F.xxhash64("v"))
    release(spark)
    candidates = ranked.read().select("vec_id", "v", "dim", "length", block.alias("block"))
    longest = dict(candidates.groupBy("block").agg(F.max("length")).collect())  # one number for candidate_block rows
    least = F.lit(LEAST).cast("long")
    asked, results, spent = candidates.where(queries).select("vec_id", "v", "dim", "length", least.alias("floor")), [], [ranked]
    first, wave = 0, 1
    while first < len(longest):
        end = min(len(longest), first + wave)
        deep = asked.withColumn("reach", _reach([longest[b] for b in range(first, end)])).where("reach > 0")
        waiting, q_block, left = ranked_blocks(deep, query_block, F.desc("reach"), F.col("vec_id"), F.xxhash64("v"))
        spent.append(waiting)
        if not left:
            break  # every query's k-th best is beyond all that is left
        q = waiting.read().withColumn("q_block", q_block)
        results.append(Stored(_meet(candidates, q, first, k), "wave"))
        release(spark)
        best = _best(_union(spark, results), k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("best"))
        asked = q.select("vec_id", "v", "dim", "length", "floor").join(best, "vec_id", "left").withColumn("floor", F.greatest("floor", F.coalesce("best", least))).drop("best")
        first, wave = end, wave * WAVE
    release(spark, *spent)
    return _best(_union(spark, results), k).select("query_id", "rank", "vec_id", "score")


def _meet(candidates: DataFrame, queries: DataFrame, first: int, k: int) -> DataFrame:
    """Every pair of blocks in reach is a group: a block of queries meets the candidates' blocks from ``first`` on that its deepest query reaches."""
    spark = candidates.sparkSession
    depth = dict(queries.groupBy("q_block").agg(F.max("reach")).collect())  # one number for query_block rows
    # queries are ordered by reach, so a block of candidates is met by the first blocks of queries
    seen = [(first + i, sum(1 for d in depth.values() if d > i) - 1) for i in range(max(depth.values()))]
    c = candidates.join(spark.createDataFrame(seen, "block bigint, last bigint"), "block")
    c = c.select("vec_id", "v", "dim", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("q_block"))
    q = queries.join(spark.createDataFrame(list(depth.items()), "q_block bigint, depth bigint"), "q_block")
    q = q.select("vec_id", "v", "dim", "floor", "q_block", F.explode(F.sequence(F.lit(first).cast("long"), first + F.col("depth") - 1)).alias("block"))
    keys = ("dim", "block", "q_block")
    return c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(_block(k), RESULT)


def _union(spark: SparkSession, parts: list[Stored]) -> DataFrame:
    return reduce(DataFrame.union, [p.read() for p in parts]) if parts else spark.createDataFrame([], RESULT)


def _best(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def oracle_sql(every: int = 20, k: int = 20, scale: int = 64) -> str:
    """The same result in DuckDB SQL."""
    return f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % {every} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
