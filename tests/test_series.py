"""Snapshot series with known outcomes, in batch and as a stream."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from papyra.operators import windows as W
from papyra.streaming import operators as S

START = datetime(2024, 1, 1)


def series(spark, counts, days, paper=1):
    return spark.createDataFrame([(paper, START + timedelta(days=days * i), c) for i, c in enumerate(counts)], "paper_id bigint, ts timestamp, citation_count bigint")


def test_linear_growth_has_velocity(spark):
    t = W.trends(W.snapshot_rates(series(spark, range(0, 20, 2), 10)), F.lit(START), 90).first()
    assert t.velocity == pytest.approx(0.2) and t.growth == 18


@pytest.mark.parametrize(("counts", "trend"), [([10, 15, 25, 40, 60], "rising"), ([20, 18, 16, 14, 12], "declining"), ([8] * 5, "stable")])
def test_classes(spark, counts, trend):
    assert W.trends(W.snapshot_rates(series(spark, counts, 20)), F.lit(START), 90).first().trend == trend


def test_burst(spark):
    rates = W.snapshot_rates(series(spark, [5, 6, 7, 8, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34], 12))
    found = W.bursts(rates).collect()
    assert [r.ts for r in found] == [START + timedelta(days=48)]


def test_nothing_within_a_day(spark):
    rows = spark.createDataFrame([(1, START, 5), (1, START + timedelta(hours=5), 9)], "paper_id bigint, ts timestamp, citation_count bigint")
    assert [(r.new_citations, r.rate) for r in W.snapshot_rates(rows).collect()] == [(0, 0.0), (0, 0.0)]


def test_forecast_of_a_steady_series(spark):
    f = W.forecast(W.snapshot_rates(series(spark, range(10, 26, 2), 7)), 7).first()
    assert (f.current, f.predicted, f.confidence) == (24, 26, "low")


def test_stream_of_snapshots_equals_the_batch(spark, tmp_path):
    both = series(spark, [1, 3, 8, 9], 2).unionByName(series(spark, [5, 5, 6], 3, 2))
    both.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(both.schema).parquet(str(tmp_path / "in"))
    q = S.snapshot_rates(stream).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    names = ["paper_id", "ts", "citation_count", "days", "new_citations", "rate", "acceleration"]
    got = sorted(tuple(r[n] for n in names) for r in spark.table("rates").collect())
    assert got == sorted(tuple(r[n] for n in names) for r in W.snapshot_rates(both).collect())


def test_rate_limit_stream_equals_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, START + timedelta(seconds=i), i % 2, "a", 1.0, "") for i in range(200)], "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = S.rate_limit(stream, 20).writeStream.format("memory").queryName("limits").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("limits").collect())) == sorted(map(tuple, S.rate_limit(rows, 20).collect()))


def test_ingest_adds_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id bigint, hash string")
    rows.write.parquet(str(tmp_path / "in"))
    for run in ("one", "two"):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        S.ingest(stream, str(tmp_path / "table"), ["id", "hash"], str(tmp_path / run)).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).collect())) == [(1, "a"), (2, "b")]


def test_batches_go_to_their_handlers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id bigint, kind string")
    rows.write.parquet(str(tmp_path / "in"))
    seen: dict[str, int] = {}

    def count(name):
        return lambda df, epoch: seen.__setitem__(name, seen.get(name, 0) + df.count())

    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    S.dispatch(stream, "kind", {"a": count("a"), "b": count("b")}, str(tmp_path / "cp")).awaitTermination(120)
    assert seen == {"a": 2, "b": 1}


def test_a_key_is_answered_once_within_its_time(spark, tmp_path):
    rows = spark.createDataFrame([(START, "q1", 1), (START + timedelta(minutes=5), "q1", 2), (START + timedelta(minutes=6), "q2", 3)], "ts timestamp, key string, n int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = S.recent_only(stream, ["key"]).writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.key for r in spark.table("firsts").collect()) == ["q1", "q2"]


def test_sessions_break_at_the_gap(spark):
    rows = spark.createDataFrame([(START + timedelta(minutes=m), 1, "a", 1.0) for m in (0, 10, 50)], "ts timestamp, user_id bigint, event_type string, value double")
    assert sorted(r.n for r in S.sessions(rows).collect()) == [1, 2]
    assert S.sliding_counts(rows).agg(F.sum("n")).first()[0] == 12
    assert [r.level for r in S.alerts(rows.withColumn("value", F.lit(95.0)), 75, 90).collect()] == ["critical"] * 3
