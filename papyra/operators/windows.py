"""Series of snapshots: rates, trends, bursts, forecasts (WN-01..11, WN-18/19, SM-06 in batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import scores as S

DAY = 86400


def _series() -> Window:
    return Window.partitionBy("paper_id").orderBy("ts")


def seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("long")


def snapshot_rates(snapshots: DataFrame) -> DataFrame:
    """WN-01/02: new citations, whole days, rate and acceleration against the snapshot before; all zero within a day."""
    w = _series()
    rows = snapshots.withColumn("days", F.coalesce(F.floor((seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(w)) / DAY), F.lit(0)))
    rows = rows.withColumn("new_citations", F.when(F.col("days") > 0, F.col("citation_count") - F.lag("citation_count").over(w)).otherwise(0).cast("long"))
    rows = rows.withColumn("rate", F.when(F.col("days") > 0, F.col("new_citations") / F.col("days")).otherwise(0.0))
    change = (F.col("rate") - F.lag("rate").over(w)) / F.col("days")
    return rows.withColumn("acceleration", F.when((F.col("days") > 0) & (F.row_number().over(w) >= 3), change).otherwise(0.0))


def trends(rates: DataFrame, since: Column, window_days: int = 30, least: int = 5) -> DataFrame:
    """WN-03..10: one row for each paper with two points or more since the cutoff and at least ``least`` citations."""
    rows = rates.where(F.col("ts") >= since)
    w, back = _series(), Window.partitionBy("paper_id").orderBy(F.desc("ts"))
    rows = rows.withColumn("i", F.row_number().over(w)).withColumn("from_last", F.row_number().over(back)).withColumn("gap", (seconds(F.col("ts")) - F.lag(seconds(F.col("ts"))).over(w)) / DAY)
    rows = rows.withColumn("positive", F.when(F.col("rate") > 0, F.col("rate")))
    rows = rows.withColumn("at", F.when(F.col("positive").isNotNull(), F.count("positive").over(w) - 1))
    p = rows.groupBy("paper_id").agg(
        F.count("*").alias("points"), F.min_by("citation_count", "ts").alias("first_count"), F.max_by("citation_count", "ts").alias("last_count"), F.min("ts").alias("t0"), F.max("ts").alias("t1"),
        F.avg("positive").alias("mean_rate"), F.avg(F.when((F.col("from_last") <= 3) & (F.col("acceleration") != 0), F.col("acceleration"))).alias("last_acc"),
        F.regr_slope("positive", F.col("at").cast("double")).alias("slope"), F.avg("gap").alias("mean_gap"),
    ).where("points >= 2")
    span = (seconds(F.col("t1")) - seconds(F.col("t0"))) / DAY
    growth = F.col("last_count") - F.col("first_count")
    rate = F.when(F.col("first_count") > 0, growth / F.col("first_count") * 100).otherwise(0.0)
    velocity = F.coalesce("mean_rate", F.when(span > 0, growth / span), F.lit(0.0))
    acceleration = F.when(F.col("points") >= 3, F.coalesce("last_acc", "slope", F.lit(0.0))).otherwise(0.0)
    p = p.withColumns({"growth": growth.cast("long"), "growth_rate": rate, "velocity": velocity, "acceleration": acceleration})
    score = S.trend_score(F.col("growth"), F.col("growth_rate"), F.col("velocity"), F.col("acceleration"), F.col("last_count"))
    p = p.withColumns({
        "score": score, "trend": S.trend_class(F.col("growth_rate"), F.col("velocity"), F.col("acceleration")), "confidence": S.trend_confidence(F.col("points"), F.col("mean_gap"), window_days),
    })
    return p.where(F.col("last_count") >= least).select("paper_id", "points", "last_count", "growth", "growth_rate", "velocity", "acceleration", "score", "trend", "confidence")


def bursts(rates: DataFrame, threshold: float = 3.0, least_points: int = 5, least_positive: int = 3) -> DataFrame:
    """WN-06: snapshots whose rate stands out by z (sample deviation of the positive rates); intensity min(z/3, 5)."""
    w = Window.partitionBy("paper_id")
    positive = F.when(F.col("rate") > 0, F.col("rate"))
    rows = rates.withColumns({"points": F.count("*").over(w), "n": F.count(positive).over(w), "mean": F.avg(positive).over(w), "sd": F.stddev_samp(positive).over(w)})
    rows = rows.where((F.col("points") >= least_points) & (F.col("n") >= least_positive) & (F.col("sd") > 0)).withColumn("z_score", (F.col("rate") - F.col("mean")) / F.col("sd"))
    return rows.where(F.col("z_score") > threshold).select("paper_id", "ts", "rate", "z_score", F.least(F.col("z_score") / 3, F.lit(5.0)).alias("intensity"))


def forecast(rates: DataFrame, days: int, least_points: int = 3) -> DataFrame:
    """WN-11: gain (mean rate + a * d / 2) * d, not negative, cut to a whole number; low confidence below ten points."""
    p = rates.groupBy("paper_id").agg(
        F.count("*").alias("points"), F.max_by("citation_count", "ts").alias("current"), F.coalesce(F.avg(F.when(F.col("rate") > 0, F.col("rate"))), F.lit(0.0)).alias("rate"),
        F.coalesce(F.avg(F.when(F.col("acceleration") != 0, F.col("acceleration"))), F.lit(0.0)).alias("acceleration"), F.coalesce(F.stddev_samp("rate"), F.lit(0.0)).alias("deviation"),
    ).where(F.col("points") >= least_points)
    gain = F.greatest((F.col("rate") + F.col("acceleration") * days / 2) * days, F.lit(0.0))
    p = p.withColumn("gain", F.floor(F.round(gain, 6)).cast("long"))
    return p.select(
        "paper_id", "current", (F.col("current") + F.col("gain")).alias("predicted"), F.when(F.col("points") < 10, "low").otherwise("medium").alias("confidence"),
        (F.col("deviation") * days).alias("margin"), F.when(F.col("acceleration") > 0, "up").when(F.col("acceleration") < 0, "down").otherwise("flat").alias("trend"),
    )


def rolling_mean(df: DataFrame, by: str, order: list[str], value: str, n: int = 10) -> DataFrame:
    """WN-18."""
    return df.withColumn("rolling", F.avg(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(1 - n, 0)))


def rank_metrics(df: DataFrame, node: str, metrics: list[str]) -> DataFrame:
    """WN-15: (metric, node, value, rank), ranks unique within a metric."""
    long = df.select(node, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select(node, "m.metric", "m.value")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("value"), node)))


def distribution(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median and deviation of a group's values."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("deviation"))


def trending_items(df: DataFrame, items: Column, ts: str, split: Column, k: int) -> DataFrame:
    """Items whose count grew most from before ``split`` to after."""
    rows = df.select(F.explode(items).alias("item"), (F.col(ts) >= split).alias("late")).groupBy("item").agg(F.sum(F.col("late").cast("long")).alias("after"), F.sum((~F.col("late")).cast("long")).alias("before"))
    return rows.withColumn("gain", F.col("after") - F.col("before")).orderBy(F.desc("gain"), "item").limit(k)
