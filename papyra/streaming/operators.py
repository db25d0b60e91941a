"""Streaming forms of the stateful parts (SM-01..07). Sliding and session windows with watermarks are extensions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from papyra.functions import scores as S
from papyra.operators.upserts import insert_if_new


def event_stream(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """Files of an events folder as a stream."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def rate_limit(events: DataFrame, limit: int = 60, late: str = "10 minutes") -> DataFrame:
    """SM-01: requests of a user in a minute and whether they pass the limit; the same code for a batch."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counts = rows.groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count("*").alias("requests"))
    return counts.select(F.col("window.start").alias("minute"), "user_id", "requests", (F.col("requests") <= limit).alias("allowed"))


def alerts(events: DataFrame, warning: float, critical: float) -> DataFrame:
    """SM-05, SF-39: rows at or above a threshold."""
    return events.withColumn("level", S.alert_level(F.col("value"), warning, critical)).where("level <> 'ok'")


def sliding_counts(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Extension."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: activity of a user with pauses shorter than ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


RATES = "paper_id bigint, ts timestamp, citation_count bigint, days bigint, new_citations bigint, rate double, acceleration double"
STATE = "seen int, at double, count bigint, rate double"


def _rates(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, at, count, rate = state.get if state.exists else (0, 0.0, 0, 0.0)
    rows = pd.concat(list(frames)).sort_values("ts")
    out: list[tuple[Any, ...]] = []
    for ts, n in zip(rows["ts"], rows["citation_count"]):
        now = ts.timestamp()
        days = int((now - at) // 86400) if seen else 0
        new = int(n) - count if days > 0 else 0
        new_rate = new / days if days > 0 else 0.0
        out.append((key[0], ts, int(n), days, new, new_rate, (new_rate - rate) / days if days > 0 and seen >= 2 else 0.0))
        seen, at, count, rate = seen + 1, now, int(n), new_rate
    state.update((seen, at, count, rate))
    yield pd.DataFrame(out, columns=["paper_id", "ts", "citation_count", "days", "new_citations", "rate", "acceleration"])


def snapshot_rates(snapshots: DataFrame) -> DataFrame:
    """SM-06: rates of a stream of (paper_id, ts, citation_count) whose rows come in order of time for each paper; state is one row for each."""
    return snapshots.groupBy("paper_id").applyInPandasWithState(_rates, RATES, STATE, "append", GroupStateTimeout.NoTimeout)


def recent_only(events: DataFrame, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    """SM-02/03: the first row of a key within the time to live, as a cache would answer the others."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def ingest(stream: DataFrame, table: str, keys: list[str], checkpoint: str, **options: str) -> Any:
    """SM-07: append rows whose keys aren't in the Parquet table yet; a batch that runs again adds nothing."""
    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        known = spark.read.schema(df.schema).parquet(table) if _there(spark, table) else spark.createDataFrame([], df.schema)
        insert_if_new(df, known, keys, [F.col(k) for k in df.columns if k in keys]).write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def dispatch(stream: DataFrame, kind: str, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None) -> Any:
    """SM-04: micro-batches handed out by type."""
    def batch(df: DataFrame, epoch: int) -> None:
        for name, handle in handlers.items():
            handle(df.where(F.col(kind) == name), epoch)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
