"""What the operators of this subpackage share: the shared folder, row batches, component labels.

Everything that outlives a stage is written to the folder named by ``spark.checkpoint.dir``; only where that
setting is absent (tests on one machine) a folder of our own is used.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only if the session names no checkpoint folder.
LOCAL_FOLDER = "file:///tmp/checkpoints"
#: Rows of one Arrow batch handed to Python; long texts make a batch of 10,000 rows too large.
BATCH_ROWS = 1000
#: Bytes of text that a Python function works on at a time.
BATCH_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = (conf or LOCAL_FOLDER).rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


class Stored:
    """A DataFrame written as Parquet in the shared folder; removed by ``drop`` or when the JVM ends."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd", **options: str):
        spark = df.sparkSession
        self.spark, self.schema = spark, df.schema
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.options = {"compression": codec, **options}
        df.write.options(**self.options).parquet(self.path)
        fs, path = _fs(spark, self.path)
        fs.deleteOnExit(path)

    def append(self, df: DataFrame) -> None:
        """More rows of the same columns."""
        df.write.mode("append").options(**self.options).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        fs, path = _fs(self.spark, self.path)
        fs.delete(path, True)


def release(spark: SparkSession, *stored: Stored) -> None:
    """Drop tables no longer read and let Spark remove the shuffle files of the finished steps."""
    for s in stored:
        s.drop()
    gc.collect()
    spark._jvm.System.gc()


def stored_in_slices(make: Callable[[int], DataFrame], slices: int, name: str) -> Stored:
    """The rows of ``make(0)``, ``make(1)``, ... one after another, so that disk holds the shuffle files of one slice at a time."""
    first = make(0)
    out = Stored(first, name)
    for k in range(1, slices):
        release(first.sparkSession)
        out.append(make(k))
    release(first.sparkSession)
    return out


def in_slice(k: int, slices: int, *columns: str) -> Column:
    """Whether a row is of slice k, by hash of the columns."""
    return F.pmod(F.xxhash64(F.lit("slice"), *columns), F.lit(slices)) == k


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold about BATCH_BYTES (a single longer text stays whole)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def text_buffer(texts: pa.Array):
    """The UTF-8 bytes of all texts in one array, and where each begins (nulls are empty)."""
    import numpy as np
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ordered_key(doc_id: Column | str) -> Column:
    """A null id takes the place before all others."""
    return F.coalesce(doc_id if isinstance(doc_id, Column) else F.col(doc_id), F.lit(-(1 << 63)).cast("long"))


def plain(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns: other columns, whatever they are called, can't clash with our own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Rows of a key beyond which it is a hub, and hubs up to which they are broadcast.
HUB, HUBS = 512, 100_000


def join_with_hubs(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``table`` on ``key``; column ``n`` of ``table``, left out of the result, is the key's number of rows.

    Keys of more than HUB rows are counted and, if they are HUBS at most, broadcast, so no task gets all rows of one.
    """
    hubs = Stored(table.where(F.col(n) > HUB).drop(n), "hubs")
    found = hubs.read().count()
    if not 0 < found <= HUBS:
        return rows.join(table.drop(n), key)
    hot = rows.join(F.broadcast(hubs.read()), key)
    cold = rows.join(F.broadcast(hubs.read().select(key)), key, "left_anti").join(table.where(F.col(n) <= HUB).drop(n), key)
    return hot.unionByName(cold)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node id reachable over undirected edges, by large-star and small-star rounds.

    Every round is two grouped minima over the edge table, so no component is gathered in one place; lineage is cut
    by ``checkpoint``. Edges may repeat; self-loops only name a node. No edges give no rows.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    nodes = e
    e = e.where("lo <> hi").distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m0"), F.count("*").alias("n")).select("u", F.least("u", "m0").alias("m"), "n")
        large = join_with_hubs(both, least, "u", "n").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        down = large.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        top = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(top, "u").select(F.explode(F.array("u", "v")).alias("hi"), F.col("m").alias("lo")).where("lo <> hi").distinct()
        e = small.select("lo", "hi").checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    ids = nodes.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()
    return ids.join(e.select(F.col("hi").alias("node"), F.col("lo").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
