"""Writes that depend on what is there: insert if new, upsert, delete, retention (SNK-01..10, ST, SRC-21)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.filters import exists_by_any_key


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """WN-16, SNK-04: the first row of each key in the order; the order must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def insert_if_new(incoming: DataFrame, known: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """SNK-01: incoming rows none of whose keys is known, one for each key among themselves."""
    fresh = exists_by_any_key(incoming, known, keys).where("not exists").drop("exists")
    for k in keys:
        with_key = latest_per_key(fresh.where(F.col(k).isNotNull()), [k], order)
        fresh = with_key.unionByName(fresh.where(F.col(k).isNull()))
    return fresh


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """SNK-04/05: new rows replace old ones of their key; among new rows the first in the order wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, [F.desc("_new"), *order]).drop("_new")


def update_columns(df: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """SNK-02: non-null values of ``updates`` (one row for each key) replace those of the row."""
    changed = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    return df.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in df.columns])


def both_ways(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """SNK-06: each unordered pair once in both directions."""
    once = pairs.withColumns({"_lo": F.least(a, b), "_hi": F.greatest(a, b)}).drop(a, b).dropDuplicates(["_lo", "_hi"])
    ways = F.explode(F.array(F.struct(F.col("_lo").alias(a), F.col("_hi").alias(b)), F.struct(F.col("_hi").alias(a), F.col("_lo").alias(b))))
    return once.withColumn("_w", ways).select(F.col(f"_w.{a}"), F.col(f"_w.{b}"), *[c for c in once.columns if c not in ("_lo", "_hi")])


def delete_keys(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """SNK-08: run it on the table and on every table that refers to it."""
    return df.join(gone.select(key), key, "left_anti")


def retain(df: DataFrame, ts: str, cutoff: Column, newest: int, order: Sequence[Column]) -> DataFrame:
    """SNK-09: rows from the cutoff on, and the newest ones whatever their age; repeated rows are rows of their own."""
    recent = F.coalesce(F.col(ts) >= cutoff, F.lit(False))
    return df.where(recent).unionByName(df.orderBy(*order).limit(newest).where(~recent))


def fill_from(first: DataFrame, second: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """SRC-21: ``n`` rows, from the second source only what the first lacks."""
    both = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)))
    return both.orderBy("_s", *order).limit(n).drop("_s")


def merge(frames: Sequence[DataFrame]) -> DataFrame:
    """ST-01/03."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def content_id(*columns: str) -> Column:
    """SNK-07: an id that a re-run gives again."""
    return F.md5(F.concat_ws("_", *columns))
