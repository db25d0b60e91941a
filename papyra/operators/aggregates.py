"""Grouped and global statistics (AG-01..30)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tall(df: DataFrame, kind: str, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), value.cast("long").alias("n"))


def counts_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AG-01/16: (kind, key, n): rows in all and by each column, from one pass over the table."""
    pairs = F.array(F.struct(F.lit("total").alias("kind"), F.lit("all").alias("key")), *[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.key").agg(F.count("*").alias("n"))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """AG-11: sorted[n div 2], average and largest. The place is found by counts of equal values, not by a list of all."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(value, "n", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col(value)))
    return placed.agg(median.alias("median"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), F.max(value).alias("most"))


def top_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """WN-17: Spark keeps k rows of a key on each task before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def endpoints(edges: DataFrame, a: str, b: str, *more: str) -> DataFrame:
    """ST-02: one row for each end of an edge."""
    return edges.select(F.explode(F.array(a, b)).alias("node"), *more)


def operation_metrics(df: DataFrame, operation: str, duration: Column, throughput: Column) -> DataFrame:
    """AG-19: throughput averages positive values only."""
    return df.groupBy(operation).agg(
        F.count("*").alias("n"), F.avg(duration).alias("avg_duration"), F.max(duration).alias("max_duration"), F.min(duration).alias("min_duration"),
        F.avg(F.when(throughput > 0, throughput)).alias("avg_throughput"), F.sum(duration).alias("total_duration"),
    )


def histogram_top(df: DataFrame, items: Column, k: int) -> DataFrame:
    """AG-16, TK-11: the k most common items of an array column."""
    return df.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(k)
