"""Ingestion by an index of keys: nothing twice, other buckets untouched, a batch that runs again, odd keys."""

from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from papyra.streaming.key_index import bucket, ingest_by_bucket

SCHEMA = "k bigint, s string, v double"


def _run(spark, tmp, rows, part: str, checkpoint: str):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp}/in-{part}")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp}/in-{part}")
    q = ingest_by_bucket(stream, f"{tmp}/table", f"{tmp}/index", ["k", "s"], f"{tmp}/{checkpoint}", buckets=16)
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(map(str, spark.read.schema(SCHEMA).parquet(f"{tmp}/table").select("k", "s", "v").collect()))


def test_keys_are_taken_once_and_only_met_buckets_are_read(spark, tmp_path):
    tmp = str(tmp_path)
    rows = [(i, "a", float(i)) for i in range(50)] + [(None, "a", 2.0), (None, "a", 1.0), (1, None, 5.0), (1, "", 6.0), (3, "a", -1.0)]
    first = _run(spark, tmp, rows, "a", "c")
    assert len(first) == 53 and "Row(k=None, s='a', v=1.0)" in first and "Row(k=3, s='a', v=-1.0)" in first
    # the same stream goes on, then a query with a new checkpoint sees all rows again
    second = _run(spark, tmp, [(3, "a", 9.0), (50, "a", 50.0)], "a", "c")
    assert len(second) == 54 and set(first) < set(second)
    assert _run(spark, tmp, [(None, "a", 7.0)], "a", "other") == second
    # a batch that runs again, its commit being lost, adds what it added before
    shutil.rmtree(f"{tmp}/c/commits")
    assert _run(spark, tmp, [], "a", "c") == second
    # buckets that a batch does not meet are not opened
    hit = spark.range(1).select(F.lit(77).cast("long").alias("k"), F.lit("a").alias("s")).select(bucket(["k", "s"], 16)).first()[0]
    broken = [p for p in tmp_path.glob("index/batch=*/bucket=*/*.parquet") if p.parent.name != f"bucket={hit}"]
    assert broken
    for p in broken:
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
        p.write_bytes(b"no parquet file")
    assert len(_run(spark, tmp, [(77, "a", 0.0)], "b", "d")) == 55
