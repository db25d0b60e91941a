"""Resolving citations against papers: a cascade of joins (JN-07..12, JN-23, SF-17..22).

Citations: citation_id, title, authors, year, doi, arxiv_id, venue. Papers: paper_id and the same fields. Every stage is an equi-join
that loses no match: titles and names meet by segments (``edits``), word sets by their rarest words, venues by their first characters.
"""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from papyra.functions import scores as S
from papyra.functions import text as T
from papyra.operators.edits import similar_strings
from papyra.session import kept

MATCH = ("citation_id", "paper_id", "match_type", "confidence", "alternatives")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """SF-17 in exact form: the ratio of matching blocks; has no counterpart among built-in functions."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def _sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def title_similarity(a: Column, b: Column, exact: bool = False) -> Column:
    """Of normalised titles: edit ratio of the texts (or the sequence ratio) and of their sorted words."""
    if exact:
        return 0.3 * sequence_ratio(a, b) + 0.4 * T.edit_ratio(a, b) + 0.3 * T.edit_ratio(_sorted_words(a), _sorted_words(b))
    return 0.5 * T.edit_ratio(a, b) + 0.5 * T.edit_ratio(_sorted_words(a), _sorted_words(b))


#: Edit ratio above which two names are one.
ALIKE = 0.8


def author_similarity(a: Column, b: Column, alike: float = ALIKE, one_to_one: bool = False) -> Column:
    """SF-18: share of names with a close one on the other side, by the longer list.

    As the results to match have it, several names may meet one; ``one_to_one`` is a fold in which a name takes the first close one still free.
    """
    if one_to_one:
        close = lambda free, x: F.array_position(F.transform(free, lambda y: T.edit_ratio(x, y) > alike), True)
        start = F.struct(b.alias("free"), F.lit(0).alias("hits"))

        def take(s: Column, x: Column) -> Column:
            rest = lambda k: F.filter(s["free"], lambda y, i: i + 1 != k)
            found = F.transform(F.array(close(s["free"], x)), lambda k: F.struct(F.when(k > 0, rest(k)).otherwise(s["free"]).alias("free"), (s["hits"] + (k > 0).cast("int")).alias("hits")))
            return F.element_at(found, 1)

        hits = F.aggregate(a, start, take, lambda s: s["hits"])
    else:
        hits = F.size(F.filter(a, lambda x: F.exists(b, lambda y: T.edit_ratio(x, y) > alike)))
    return F.coalesce(F.try_divide(hits, F.greatest(F.size(a), F.size(b))), F.lit(0.0))


def _prepared(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.select(
        key, T.normalize_title(F.coalesce("title", F.lit(""))).alias(f"{prefix}title"), T.author_names(F.coalesce("authors", F.lit(""))).alias(f"{prefix}names"), F.col("year").alias(f"{prefix}year"),
        F.lower("doi").alias(f"{prefix}doi"), F.lower("arxiv_id").alias(f"{prefix}arxiv"), F.lower("venue").alias(f"{prefix}venue"),
    )


def _best(rows: DataFrame, kind: str) -> DataFrame:
    """The best paper of each citation (smaller id on ties), the others that passed as alternatives."""
    w = Window.partitionBy("citation_id").orderBy(F.desc(F.round("confidence", 9)), "paper_id")
    ranked = rows.withColumn("n", F.row_number().over(w)).groupBy("citation_id")
    out = ranked.agg(
        F.min(F.when(F.col("n") == 1, F.col("paper_id"))).alias("paper_id"), F.max(F.when(F.col("n") == 1, F.col("confidence"))).alias("confidence"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("paper_id")))).alias("alternatives"),
    )
    return out.withColumn("match_type", F.lit(kind)).select(*MATCH)


def by_key(c: DataFrame, p: DataFrame, key: str, confidence: float) -> DataFrame:
    """JN-07: equal identifiers, letter case aside."""
    met = c.where(F.col(f"c_{key}").isNotNull()).join(p, F.col(f"c_{key}") == F.col(f"p_{key}"))
    return _best(met.select("citation_id", "paper_id", F.lit(confidence).alias("confidence")), key)


def title_candidates(c: DataFrame, p: DataFrame, least: float = 0.8, exact: bool = False) -> DataFrame:
    """(citation_id, paper_id) of all titles that may be alike above ``least``.

    A weighted mean above ``least`` needs an edit ratio above it, of the texts or of their sorted words; in exact form, where the sequence ratio may be 1,
    an edit ratio above (least - 0.3) / 0.7. Both are found by segments, among distinct strings.
    """
    ratio = (least - 0.3) / 0.7 if exact else least
    a, b = c.select("citation_id", F.col("c_title").alias("t")), p.select("paper_id", F.col("p_title").alias("t"))
    met = []
    for form in (F.col("t"), _sorted_words(F.col("t"))):
        x, y = a.select("citation_id", form.alias("s")), b.select("paper_id", form.alias("s"))
        pairs = similar_strings(x, y, ratio)
        met.append(pairs.join(x, F.col("a") == x["s"]).drop("s").join(y, F.col("b") == y["s"]).select("citation_id", "paper_id"))
    return met[0].union(met[1]).distinct()


def by_title(c: DataFrame, p: DataFrame, least: float = 0.8, shortest: int = 10, exact: bool = False) -> DataFrame:
    """JN-08: titles alike above ``least``."""
    a = c.where(F.length("c_title") >= shortest)
    rows = title_candidates(a, p, least, exact).join(a, "citation_id").join(p, "paper_id")
    longer, shorter = F.greatest(F.length("c_title"), F.length("p_title")), F.least(F.length("c_title"), F.length("p_title"))
    if not exact:  # an edit ratio is at most shorter / longer
        rows = rows.where(shorter > least * longer)
    rows = rows.withColumn("s", title_similarity(F.col("c_title"), F.col("p_title"), exact))
    return _best(rows.where(F.col("s") > least).select("citation_id", "paper_id", (0.9 * F.col("s")).alias("confidence")), "title")


def by_author_year(c: DataFrame, p: DataFrame, least: float = 0.7) -> DataFrame:
    """JN-09: equal year, authors alike; 0.2 more if the titles are; confidence min(0.8 s, 0.9).

    Lists alike above ``least`` have a pair of close names, so close names, found by segments, join beside the year.
    """
    named = lambda df, key, names, year: df.where(F.col(year).isNotNull()).select(key, F.col(year).alias("y"), F.explode(F.array_distinct(names)).alias("s"))
    x, y = named(c, "citation_id", "c_names", "c_year"), named(p, "paper_id", "p_names", "p_year")
    close = similar_strings(x, y, ALIKE)
    met = x.withColumnRenamed("s", "a").join(close, "a").join(y.withColumnRenamed("s", "b"), ["b", "y"]).select("citation_id", "paper_id").distinct()
    rows = met.join(c, "citation_id").join(p, "paper_id").withColumn("s", author_similarity(F.col("c_names"), F.col("p_names"))).where(F.col("s") > least)
    rows = rows.withColumn("s", F.col("s") + F.when(title_similarity(F.col("c_title"), F.col("p_title")) > 0.6, 0.2).otherwise(0.0))
    return _best(rows.select("citation_id", "paper_id", F.least(0.8 * F.col("s"), F.lit(0.9)).alias("confidence")), "author_year")


def combined_score() -> Column:
    """SF-19."""
    title = F.when((F.col("c_title") != "") & (F.col("p_title") != ""), title_similarity(F.col("c_title"), F.col("p_title")))
    names = F.when((F.size("c_names") > 0) & (F.size("p_names") > 0), author_similarity(F.col("c_names"), F.col("p_names")))
    gap = F.abs(F.col("c_year") - F.col("p_year"))
    year = F.when(gap == 0, 1.0).when(gap == 1, 0.5).when(gap.isNotNull(), 0.0)
    like = T.edit_ratio(F.col("c_venue"), F.col("p_venue"))
    venue = F.when(F.col("c_venue").isNotNull() & F.col("p_venue").isNotNull(), F.when(like > 0.7, 1.0).otherwise(0.0))
    return S.present_weighted((title, 0.4), (names, 0.3), (year, 0.2), (venue, 0.1))


def contained_strings(inner: DataFrame, outer: DataFrame, most: int = 3) -> DataFrame:
    """(inner, outer): distinct strings (column ``s``) of which one contains the other; an equi-join on the inner one's first ``most`` characters (all, if fewer)."""
    x, y = inner.where("s is not null").select(F.col("s").alias("inner")).distinct(), outer.where("s is not null").select(F.col("s").alias("outer")).distinct()

    def grams_of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("outer") - k + 1, F.lit(1))), lambda i: F.substring(F.col("outer"), i, F.lit(k)))

    grams = F.array_distinct(F.flatten(F.array(F.array(F.lit("")), *map(grams_of, range(1, most + 1)))))
    met = x.withColumn("g", F.substring("inner", 1, most)).join(y.select("outer", F.explode(grams).alias("g")), "g")
    return met.where(F.contains("outer", "inner")).select("inner", "outer").distinct()


def by_combined(c: DataFrame, p: DataFrame, least: float = 0.6) -> DataFrame:
    """JN-10: years at most one apart and one venue in the other; a band join by exploded years beside pairs of venues. Confidence min(0.7 s, 0.8)."""
    cv, pv = c.select(F.col("c_venue").alias("s")), p.select(F.col("p_venue").alias("s"))
    venues = contained_strings(cv, pv).select(F.col("inner").alias("c_venue"), F.col("outer").alias("p_venue")).union(contained_strings(pv, cv).select("outer", "inner")).distinct()
    banded = c.join(venues, "c_venue").withColumn("y", F.explode(F.sequence(F.col("c_year") - 1, F.col("c_year") + 1)))
    rows = banded.join(p.withColumn("y", F.col("p_year")), ["y", "p_venue"])
    rows = rows.withColumn("s", combined_score()).where(F.col("s") > least)
    return _best(rows.select("citation_id", "paper_id", F.least(0.7 * F.col("s"), F.lit(0.8)).alias("confidence")), "combined")


def resolve(citations: DataFrame, papers: DataFrame, exact: bool = False) -> DataFrame:
    """JN-11: the first stage that finds a paper decides: doi, arxiv, title, author_year, combined."""
    # both sides go through several joins: they are computed once
    c, p = kept(_prepared(citations, "citation_id", "c_")), kept(_prepared(papers, "paper_id", "p_"))
    stages = (lambda r: by_key(r, p, "doi", 0.95), lambda r: by_key(r, p, "arxiv", 0.95), lambda r: by_title(r, p, exact=exact), lambda r: by_author_year(r, p), lambda r: by_combined(r, p))
    found: list[DataFrame] = []
    for stage in stages:
        found.append(kept(stage(c)))
        c = kept(c.join(found[-1].select("citation_id"), "citation_id", "left_anti"))
    return reduce(DataFrame.unionByName, found)


def shared_word_pairs(a: DataFrame, b: DataFrame, least: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(x, y): rows (x, w, keys) and (y, w, keys) of equal keys whose word sets have a Jaccard similarity that may be above ``least`` (0 at least).

    Sets of n words above ``least`` share more than n * least words, so of the n - floor(n * least) rarest of each, one is shared: common words join only
    where a set has hardly others. Words are ordered by how many sets hold them, ties by hash.
    """
    sets = a.select("w").union(b.select("w"))
    often = sets.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(key, *keys, F.size("w").alias("size"), F.explode("w").alias("word")).join(often, "word")
        listed = rows.groupBy(key, *keys, "size").agg(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("word").alias("h"), "word"))).alias("l"))  # a title's words
        sent = F.col("size") - F.floor(F.col("size") * least + 1e-9).cast("int")
        return listed.select(key, *keys, F.explode(F.slice("l", F.lit(1), F.greatest(sent, F.lit(1)))).alias("t")).select(key, *keys, "t.word")

    return prefix(a, "x").join(prefix(b, "y"), ["word", *keys]).select("x", "y").distinct()


def _title_words(df: DataFrame, key: str, title: str, name: str, *more: tuple[str, str]) -> DataFrame:
    words = F.filter(F.array_distinct(F.split(title, " ")), lambda w: w != "")
    return df.select(F.col(key).alias(name), words.alias("w"), *[F.col(a).alias(b) for a, b in more])


def best_of_all(citations: DataFrame, papers: DataFrame, least: float = 0.5) -> DataFrame:
    """JN-12, SF-22: doi 1, arxiv 0.95, title 0.8 * Jaccard above 0.8, authors and year 0.6; the best above ``least``."""
    c, p = _prepared(citations, "citation_id", "c_"), _prepared(papers, "paper_id", "p_")
    ca, pa = c.withColumn("c_words", F.array_distinct(F.split("c_title", " "))), p.withColumn("p_words", F.array_distinct(F.split("p_title", " ")))
    doi = ca.join(pa, F.col("c_doi") == F.col("p_doi")).select("citation_id", "paper_id", F.lit(1.0).alias("confidence"))
    arxiv = ca.join(pa, F.col("c_arxiv") == F.col("p_arxiv")).select("citation_id", "paper_id", F.lit(0.95).alias("confidence"))
    met = shared_word_pairs(_title_words(c, "citation_id", "c_title", "x"), _title_words(p, "paper_id", "p_title", "y"), 0.8).select(F.col("x").alias("citation_id"), F.col("y").alias("paper_id"))
    n = F.size(F.array_intersect("c_words", "p_words"))
    j = n / (F.size("c_words") + F.size("p_words") - n)
    title = met.join(ca, "citation_id").join(pa, "paper_id").withColumn("j", j).where(F.col("j") > 0.8).select("citation_id", "paper_id", (0.8 * F.col("j")).alias("confidence"))
    last = lambda c: F.explode(F.array_distinct(T.last_names(F.col(c)))).alias("last")
    banded = c.select("citation_id", F.explode(F.sequence(F.col("c_year") - 1, F.col("c_year") + 1)).alias("y"), "c_names").select("citation_id", "y", last("c_names"))
    names = banded.join(p.select("paper_id", F.col("p_year").alias("y"), last("p_names")), ["y", "last"]).select("citation_id", "paper_id", F.lit(0.6).alias("confidence"))
    rows = reduce(DataFrame.unionByName, (doi, arxiv, title, names)).groupBy("citation_id", "paper_id").agg(F.max("confidence").alias("confidence"))
    return _best(rows.where(F.col("confidence") > least), "best").drop("alternatives", "match_type")


def simple(citations: DataFrame, papers: DataFrame, least: float = 0.5) -> DataFrame:
    """JN-23: equal arXiv id 0.95, else equal year 0.3 + 0.6 * title Jaccard; the best above ``least``, which is 0.3 at least (a year alone is no match)."""
    if least < 0.3:
        raise ValueError("an equal year alone would match")
    c, p = _prepared(citations, "citation_id", "c_"), _prepared(papers, "paper_id", "p_")
    arxiv = c.join(p, F.col("c_arxiv") == F.col("p_arxiv")).select("citation_id", "paper_id", F.lit(0.95).alias("confidence"))
    j = T.jaccard(F.split("c_title", " "), F.split("p_title", " "))
    # the empty word of an empty title counts as a word of it, so it is one here too
    words = lambda df, key, title, name, year: df.where(F.col(year).isNotNull()).select(F.col(key).alias(name), F.array_distinct(F.split(title, " ")).alias("w"), F.col(year).alias("year"))
    met = shared_word_pairs(words(c, "citation_id", "c_title", "x", "c_year"), words(p, "paper_id", "p_title", "y", "p_year"), (least - 0.3) / 0.6, ("year",))
    rows = met.select(F.col("x").alias("citation_id"), F.col("y").alias("paper_id")).join(c, "citation_id").join(p, "paper_id")
    year = rows.select("citation_id", "paper_id", (0.3 + 0.6 * j).alias("confidence"))
    rows = arxiv.unionByName(year).groupBy("citation_id", "paper_id").agg(F.max("confidence").alias("confidence"))
    return _best(rows.where(F.col("confidence") > least), "simple").drop("alternatives", "match_type")


def resolution_statistics(citations: DataFrame, matches: DataFrame) -> DataFrame:
    """AG-14."""
    m = citations.select("citation_id").join(matches, "citation_id", "left")
    return m.agg(
        F.count("*").alias("citations"), F.count("paper_id").alias("resolved"), F.coalesce(F.try_divide(F.count("paper_id"), F.count("*")), F.lit(0.0)).alias("rate"),
        F.avg("confidence").alias("avg_confidence"), F.count_if(F.size("alternatives") > 0).alias("ambiguous"),
    )
