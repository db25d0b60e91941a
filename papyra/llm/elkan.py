"""Centroid clustering with triangle-inequality bounds: cached upper and lower bounds skip distances, results are exact integers.

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to each of the k
centroids. When centroids move, bounds give way by as much. A vector whose upper bound lies under half the distance from
its centroid to the nearest other one keeps its centroid without any computation; a single other centroid is skipped if
its lower bound, or half its distance from the vector's centroid, lies above the upper bound. Bounds are doubles rounded
away from the vector, and skip only where strictly smaller, so ties are always computed. Whatever isn't skipped is an
exact integer distance. Centroids are replaced by the floor of the exact mean.

A round is one pass over the stored vectors without a shuffle: tasks write vectors with their new bounds, and one row of
sums for each task; Spark adds these up, and k * (dim + 2) numbers reach the driver. Rounds end early once no centroid
moves, since all further rounds would be the same.

Defined results: a vector of another size, null, or with null or non-finite components takes no part; repeated rows are
vectors of their own; a null vec_id is hashed as ``null``; with fewer vectors than k there are as many centroids as
vectors; an empty table gives an empty table; other columns are ignored. Scaled components beyond 64 bits are the nearest
64-bit number, and so are distances and their sums where they are returned (they are compared exactly).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.norm_topk import MOST, scaled, usable
from papyra.llm.shared import Stored, plain

#: Relative room given to every bound; far above the error of one double operation.
ROOM = 2.0**-50
#: Components up to which distances of DIM components can't pass 64 bits.
SMALL = 1 << 27


@dataclass(frozen=True)
class ElkanSetting:
    k: int = 8
    dim: int = 64
    scale: int = 1024
    rounds: int = 10
    seed: str = "3"


def _rows(values: list[list[int]]) -> np.ndarray:
    """Rows of integers, as 64-bit numbers where distances fit these, else as Python's own."""
    small = all(abs(v) <= SMALL for row in values for v in row)
    return np.array(values, np.int64 if small else object)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x from c, one row or as many as x has."""
    d = x - c
    return (d * d).sum(1)


def _root(d: np.ndarray, up: bool) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + ROOM if up else 1 - ROOM)


def half_distances(c: np.ndarray) -> np.ndarray:
    """Half the distance of each two centroids, rounded down; infinite from a centroid to itself."""
    half = np.stack([_root(distances(c, c[j]), False) for j in range(len(c))]) / 2
    np.fill_diagonal(half, np.inf)
    return half


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, half: np.ndarray) -> int:
    """Nearest centroid of each row of x, ties to the smaller number; changes cluster, upper and lower in place. Returns how many distances it computed."""
    every = np.arange(len(c))
    live = np.flatnonzero(~(upper < half.min(1)[cluster]))

    def open_(rows: np.ndarray) -> np.ndarray:
        u, a = upper[rows, None], cluster[rows]
        return ~(u < lower[rows]) & ~(u < half[a]) & (every != a[:, None])

    live = live[open_(live).any(1)]
    best = distances(x[live], c[cluster[live]]) if len(live) else np.zeros(0, np.int64)
    upper[live], lower[live, cluster[live]] = _root(best, True), _root(best, False)
    computed = len(live)
    for j in every:
        at = np.flatnonzero(open_(live)[:, j])
        if not len(at):
            continue
        rows, d = live[at], distances(x[live[at]], c[j])
        computed += len(at)
        lower[rows, j] = _root(d, False)
        nearer = ((d < best[at]) | ((d == best[at]) & (j < cluster[rows]))).astype(bool)
        at, rows, d = at[nearer], rows[nearer], d[nearer]
        best[at], cluster[rows], upper[rows] = d, j, _root(d, True)
    return computed


STATE = "vec_id bigint, x array<bigint>, cluster int, upper double, lower array<double>, distance bigint, sums array<string>"
STATE_SCHEMA = pa.schema(
    [("vec_id", pa.int64()), ("x", pa.list_(pa.int64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("distance", pa.int64()), ("sums", pa.list_(pa.string()))]
)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(n, -1)


def _pass(centroids: list[list[int]], moved: list[float] | None, last: bool):
    """One round over a task's vectors; then a row of sums: for each centroid its components, count and distances, and last the number of distances computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = len(centroids), len(centroids[0])
        total, computed = np.zeros((k, dim + 2), object), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, c = _matrix(batch.column("x"), n), _rows(centroids)
            if c.dtype == object or np.abs(x).max() > SMALL or x.min() < -SMALL:
                x, c = x.astype(object), c.astype(object)
            if moved is None:
                cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k))
            else:
                cluster, shift = np.array(batch.column("cluster")), np.asarray(moved)
                upper = (np.asarray(batch.column("upper")) + shift[cluster]) * (1 + ROOM)
                lower = np.maximum(0, (_matrix(batch.column("lower"), n) - shift) * (1 - ROOM))
            computed += assign(x, cluster, upper, lower, c, half_distances(c))
            distance = distances(x, c[cluster]) if last else None
            for j in np.unique(cluster):
                own = cluster == j
                total[j, :dim] += x[own].sum(0).astype(object)
                total[j, dim] += int(own.sum())
                if last:
                    total[j, dim + 1] += int(distance[own].astype(object).sum())
            out = pa.array([min(int(d), MOST) for d in distance], pa.int64()) if last else pa.nulls(n, pa.int64())
            kept = batch.column("x") if not last else pa.nulls(n, pa.list_(pa.int64()))
            bounds = pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), lower.ravel()) if not last else pa.nulls(n, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), kept, pa.array(cluster, pa.int32()), pa.array(upper), bounds, out, pa.nulls(n, pa.list_(pa.string()))], schema=STATE_SCHEMA)
        yield pa.RecordBatch.from_pylist([{"sums": [str(v) for v in total.ravel()] + [str(computed)]}], schema=STATE_SCHEMA)

    return run


@dataclass
class Clusters:
    """Vectors with cluster and distance, the centroids, each cluster's and the whole inertia, and the number of distances computed in each pass."""

    vectors: DataFrame
    centroids: list[list[int]]
    inertia: list[int]
    computed: list[int]


def cluster(vectors: DataFrame, s: ElkanSetting = ElkanSetting()) -> Clusters:
    """Cluster the vectors of column ``embedding``; rows (vec_id, cluster, distance)."""
    table = plain(vectors, ("vec_id", "embedding")).where(usable(F.col("embedding")) & (F.size("embedding") == s.dim))
    vec_id = F.col("vec_id").cast("bigint").alias("vec_id")
    state = Stored(table.select(vec_id, scaled(F.col("embedding"), s.scale).alias("x")), "vectors")
    key = F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = state.read().select("vec_id", "x", key.alias("key")).orderBy("key", "vec_id", "x").limit(s.k).collect()
    centroids, moved, computed = [list(r["x"]) for r in first], None, []
    if not centroids:
        return Clusters(vectors.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), [], [], [])
    settled = False
    for step in range(s.rounds + 1):
        last = settled or step == s.rounds
        rows = state.read() if moved is None else state.read().where("sums is null")
        after = Stored(rows.mapInArrow(_pass(centroids, moved, last), STATE), "clusters")
        state.drop()
        state = after
        sums = state.read().where("sums is not null").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        added = {r["i"]: int(r["v"]) for r in sums.collect()}  # k * (dim + 2) + 1 numbers
        width = s.dim + 2
        total = [[added[j * width + i] for i in range(width)] for j in range(len(centroids))]
        computed.append(added[len(centroids) * width])
        if last:
            break
        new = [[v // t[s.dim] for v in t[: s.dim]] if t[s.dim] else c for t, c in zip(total, centroids)]
        old, now = np.array(centroids, object), np.array(new, object)
        moved = [float(m) for m in _root(distances(old, now), True)]
        settled, centroids = new == centroids, new
    return Clusters(state.read().where("sums is null").select("vec_id", "cluster", "distance"), centroids, [t[s.dim + 1] for t in total], computed)


def digest(found: Clusters) -> DataFrame:
    """The vectors with their cluster's and the whole inertia and the sha256 of their centroid."""
    if not found.centroids:
        none = F.lit(None)
        return found.vectors.select("*", none.cast("bigint").alias("cluster_inertia"), none.cast("bigint").alias("inertia"), none.cast("string").alias("centroid_sha256"))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]

    def of(values: list):
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    each = [min(v, MOST) for v in found.inertia]
    return found.vectors.select("*", of(each).cast("bigint").alias("cluster_inertia"), F.lit(min(sum(found.inertia), MOST)).cast("bigint").alias("inertia"), of(sha).alias("centroid_sha256"))


def oracle_sql(s: ElkanSetting = ElkanSetting()) -> str:
    """Every vector against every centroid in every round."""

    def assigned(step: int) -> str:
        return f"""a{step} AS MATERIALIZED (SELECT vec_id, x, unnest(best, recursive := true) FROM (SELECT vec_id, x, min(struct_pack(distance := d, cluster := c)) AS best FROM
  (SELECT v.vec_id, v.x, v.rowid, c, list_sum(list_transform(list_zip(v.x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{step}) GROUP BY vec_id, x, rowid))"""

    def moved(step: int) -> str:
        return f"""c{step + 1} AS MATERIALIZED (SELECT c, coalesce(n, m) AS m FROM c{step} LEFT JOIN (SELECT cluster AS c, list(CAST((t - ((t % k + k) % k)) // k AS BIGINT) ORDER BY i) AS n FROM
  (SELECT cluster, i, sum(y) AS t, count(*) AS k FROM (SELECT cluster, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{step}) GROUP BY 1, 2) GROUP BY 1) USING (c))"""

    steps = ",\n".join(reduce(lambda out, i: [*out, assigned(i), moved(i)], range(s.rounds), []))
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda z: CAST(floor({s.scale} * CAST(z AS DOUBLE)) AS BIGINT)) AS x, row_number() OVER () AS rowid FROM embeddings
  WHERE len(embedding) = {s.dim} AND len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z))) = {s.dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id, x) - 1 AS c, x AS m FROM (SELECT *, sha256('{s.seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h FROM v ORDER BY h, vec_id, x LIMIT {s.k})),
{steps},
{assigned(s.rounds)}
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{s.rounds} JOIN c{s.rounds} ON c = cluster"""
