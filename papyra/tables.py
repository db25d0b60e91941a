"""Readers of the driver's tables, and the domain views made of them.

The tables hold no citations, so links come from order lines: two parts that follow each other in an order are an edge, and
supplier and customer nations with more than the usual number of lines between them are a small graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.session import steady


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst) of parts that follow each other in an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return lines.where("dst is not null and src <> dst").select("src", "dst").distinct()


PART_EDGES_SQL = """edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst
  FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst, weight): supplier nation to customer nation with more lines than the average pair. Stored, so that what is built on it joins the tables once."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    pairs = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    counts = pairs.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return steady(counts.withColumn("mean", F.avg("weight").over(Window.partitionBy())).where("weight > 1.15 * mean").drop("mean"))


NATION_EDGES_SQL = """counts AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
edges AS (SELECT src, dst, weight FROM counts WHERE weight > 1.15 * (SELECT avg(weight) FROM counts))"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, ts, citation_count): a user's events so far, at the end of each day with events."""
    days = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("paper_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"))
    return days.select("paper_id", "ts", F.sum("n").over(Window.partitionBy("paper_id").orderBy("ts")).alias("citation_count"))


SNAPSHOTS_SQL = """snaps AS (SELECT paper_id, ts, CAST(sum(n) OVER (PARTITION BY paper_id ORDER BY ts) AS BIGINT) AS citation_count FROM
  (SELECT user_id AS paper_id, date_trunc('day', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2))"""
