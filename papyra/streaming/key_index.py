"""SM-07 over a long history: new rows by an index of keys in hash buckets, of which a batch reads only its own."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.streaming.operators import _there

BUCKETS = 256


def bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def ingest_by_bucket(stream: DataFrame, table: str, index: str, keys: list[str], checkpoint: str, buckets: int = BUCKETS, **trigger: Any) -> Any:
    """Append a stream's rows to the Parquet folder ``table`` unless their keys are there, and their keys to ``index``.

    The table is not read. The index holds keys only, in folders by bucket of their hash, and a batch reads the buckets
    its keys fall into (their numbers, ``buckets`` at most, reach the driver). Both are written to folders of the batch,
    named by the query's id and the batch's number, which a batch that runs again leaves out of its look and overwrites:
    it adds what it added before. A query with a new checkpoint finds all keys there and adds nothing.

    Of rows with equal keys in one batch the one with the smallest other columns stays, whatever the order they come in
    (so these must be orderable); null keys equal null. ``buckets`` must stay as it was when the index began. Streams
    into one table must run one after another. A bucket has a file for each batch with keys in it: use batches that are large.
    """
    names: list[str] = []

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        if not names:
            names.append(json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        name = f"{names[0]}-{epoch}"
        rest = [c for c in df.columns if c not in keys]
        row = F.min(F.struct(*rest) if rest else F.lit(0)).alias("row")
        once = df.groupBy(*keys).agg(row).withColumn("bucket", bucket(keys, buckets)).persist()
        try:
            met = [r[0] for r in once.select("bucket").distinct().collect()]
            if not met:
                return
            new = once
            if _there(spark, index):
                known = seen(spark.read.schema(once.select(*keys, "bucket", F.lit("").alias("batch")).schema).parquet(index), met, name)
                new = once.alias("n").join(known.alias("k"), [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in [*keys, "bucket"]], "left_anti")
            new = new.persist()
            try:
                new.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in df.columns]).write.mode("overwrite").parquet(f"{table}/batch={name}")
                # by bucket, so that a bucket gets one file
                new.select(*keys, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{index}/batch={name}")
            finally:
                new.unpersist()
        finally:
            once.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def seen(index: DataFrame, met: list[int], batch: str) -> DataFrame:
    """Keys of these buckets from other batches: both conditions choose folders."""
    return index.where(F.col("bucket").isin(met) & (F.col("batch") != batch)).drop("batch")
