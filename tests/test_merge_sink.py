"""Nothing shows before the commit, a task that runs again leaves no double row, and so does a job."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from papyra.sources import merge_sink as S


def rows_of(path) -> dict:
    con = sqlite3.connect(path)
    return {k: json.loads(r) for k, r in con.execute("SELECT key, row FROM papers")}


def test_batches_and_reruns(spark, tmp_path):
    spark.dataSource.register(S.MergeSink)
    path = f"{tmp_path}/store.db"
    df = spark.range(2500).select("id", (F.col("id") % 7).alias("v"), F.array("id").alias("list")).repartition(3)

    def save(d):
        d.write.format("merge_sink").option("store", "papyra.sources.merge_sink.TableStore").option("database", path).option("table", "papers").option("key", "id").option("batch", "400").mode("append").save()

    save(df)
    first = rows_of(path)
    assert len(first) == 2500 and first["[9]"] == {"id": 9, "v": 2, "list": [9]}
    save(df)
    assert rows_of(path) == first
    save(df.where("id < 10").withColumn("v", F.lit(-1).cast("bigint")))
    assert sum(r["v"] == -1 for r in rows_of(path).values()) == 10 and len(rows_of(path)) == 2500
    with pytest.raises(Exception):
        save(df.select("id", F.raise_error(F.lit("lost")).cast("bigint").alias("v")))
    assert len(rows_of(path)) == 2500


def test_only_named_attempts_are_merged(tmp_path):
    options = {"store": "papyra.sources.merge_sink.TableStore", "database": f"{tmp_path}/s.db", "table": "papers", "key": "id,part", "batch": "2"}
    writer = S._MergeWriter(options)
    lost, again = (writer.write(iter([Row(id=i, part=0, v=v) for i in range(5)])) for v in ("lost", "again"))
    other = writer.write(iter([Row(id=i, part=1, v="x") for i in range(3)]))
    assert len(lost.names) == 3 and rows_of(options["database"]) == {}
    writer.commit([again, None, other])
    assert {r["v"] for r in rows_of(options["database"]).values()} == {"again", "x"} and len(rows_of(options["database"])) == 8
    writer.abort([lost])
    assert sqlite3.connect(options["database"]).execute("SELECT count(*) FROM papers_staged").fetchone() == (0,)
    assert writer.write(iter([])).names == []
    with pytest.raises(ValueError):
        S._MergeWriter({**options, "batch": "0"})
