"""Predicates and search by plain conditions (FLT-01..17, TK-01..03, PRJ)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as T


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset..offset+limit of an order; give a unique last key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def like_search(df: DataFrame, query: str | None, columns: Sequence[str], source: str | None = None) -> DataFrame:
    """FLT-03: case-insensitive containment in any column, and source equality; absent conditions are ignored."""
    if query:
        df = df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(query.lower())) for c in columns]))
    return df.where(F.col("source") == source) if source else df


def any_term(df: DataFrame, terms: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """FLT-04."""
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(t.lower())) for t in terms for c in columns]))


def first_matching_field(df: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """FLT-05: adds ``match_field``, the first column that holds the query; other rows go."""
    match = F.coalesce(*[F.when(F.contains(F.lower(f), F.lit(query.lower())), F.lit(f)) for f in fields])
    return df.withColumn("match_field", match).where("match_field is not null")


def _times(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def fulltext(df: DataFrame, terms: Sequence[str], column: str = "text", every: bool = True) -> DataFrame:
    """FLT-06/07: rows with all (or any) terms among their words, and ``rank`` = sum of term counts / (1 + ln words)."""
    own = T.words(F.col(column))
    hits = [_times(F.col("_w"), t) for t in terms]
    test = reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), [h > 0 for h in hits])
    rank = sum(hits, F.lit(0)) / (1 + F.log(F.size("_w")))
    return df.withColumn("_w", own).where(test).withColumn("rank", rank).drop("_w")


def metadata_filter(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """FLT-08: a list means any of it, a string case-insensitive containment, other values equality; unknown columns are ignored."""
    for name, value in filters.items():
        if name not in df.columns:
            continue
        c = F.col(f"`{name}`")
        if isinstance(value, (list, tuple, set)):
            df = df.where(c.isin(*value))
        elif isinstance(value, str):
            df = df.where(F.contains(F.lower(c.cast("string")), F.lit(value.lower())))
        else:
            df = df.where(c == value)
    return df


def related(df: DataFrame, node: Any, relation: str | None = None, ends: tuple[str, str] = ("source_id", "target_id")) -> DataFrame:
    """FLT-10: rows with the node at either end, of one relation if given, best first."""
    df = df.where((F.col(ends[0]) == node) | (F.col(ends[1]) == node))
    return (df.where(F.col("relation") == relation) if relation else df).orderBy(F.desc("score"), *ends)


def recent(df: DataFrame, ts: str, as_of: str, days: float) -> DataFrame:
    """FLT-13."""
    end = F.to_timestamp_ntz(F.lit(as_of))
    return df.where((F.col(ts) >= end - F.expr(f"INTERVAL '{int(days * 86400)}' SECOND")) & (F.col(ts) <= end))


def exists_by_any_key(candidates: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FLT-01 in bulk: ``exists`` tells whether any non-null key of a candidate is known; keys are looked up one by one, not by OR."""
    out = candidates
    for k in keys:
        seen = known.where(F.col(k).isNotNull()).select(F.col(k).alias(f"_{k}")).distinct()
        out = out.join(seen.withColumn(f"_has_{k}", F.lit(True)), F.col(k) == F.col(f"_{k}"), "left").drop(f"_{k}")
    return out.withColumn("exists", reduce(lambda a, b: a | b, [F.coalesce(f"_has_{k}", F.lit(False)) for k in keys])).drop(*[f"_has_{k}" for k in keys])


def integrity_issues(df: DataFrame, keys: Mapping[str, tuple[DataFrame, str]], score: str, low: float, high: float) -> DataFrame:
    """FLT-14: (issue, n): references without a row, and scores out of range."""
    issues = [df.join(d.select(F.col(k).alias("_k")), F.col(c) == F.col("_k"), "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"dangling_{c}").alias("issue"), "n") for c, (d, k) in keys.items()]
    issues.append(df.where(~F.col(score).between(low, high)).agg(F.count("*").alias("n")).select(F.lit(f"range_{score}").alias("issue"), "n"))
    return reduce(DataFrame.unionByName, issues)


def valid_question(c: Column, blocked: Sequence[str], shortest: int = 3, longest: int = 1000) -> Column:
    """FLT-15."""
    return F.length(F.trim(c)).between(shortest, longest) & ~T.any_of(F.lower(c), blocked)


def valid_citation(doi: Column, arxiv: Column, title: Column, raw: Column, confidence: Column) -> Column:
    """FLT-16."""
    return F.coalesce(doi, arxiv, title).isNotNull() & (F.length(raw) >= 20) & (confidence >= 0.1)


def text_of(*columns: Column) -> Column:
    """PRJ-02: the first text that isn't blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def shorten(c: Column, n: int) -> Column:
    """PRJ-04."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def first_year(c: Column) -> Column:
    """PRJ-03: the first four characters as a number, else null."""
    return F.substring(c, 1, 4).try_cast("int")
