"""Joins by segments, rare words and venue characters against all pairs; names one to one against a plain fold."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import edits as E
from papyra.operators import resolution as Z

FIELDS = "title string, authors string, year int, doi string, arxiv_id string, venue string"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.sampled_from("ab c")), max_size=8), st.sampled_from([0.8, 5 / 7, 0.6]))
def test_segments_lose_no_pair(a, edits, ratio):
    b = a
    for kind, at, letter in edits:
        at %= len(b) + 1
        b = b[:at] + (letter if kind < 2 else "") + b[at + (kind > 0) :]
    x, y = sorted((a, b), key=len)
    if x and 1 - distance(x, y) / len(y) > ratio + 1e-9:
        known = {(y[s : s + n], len(y), i) for i, (s, n) in enumerate(E.segments(len(y), ratio))}
        assert any((x[s : s + n], longer, i) in known for s, n, longer, i in E.places(len(x), ratio, True).tolist())


def perturbed(rng: random.Random, s: str, most: int) -> str:
    for _ in range(rng.randint(0, most)):
        at = rng.randrange(len(s) + 1)
        s = s[:at] + rng.choice(["", "x", "é", " "]) + s[at + rng.randint(0, 1) :]
    return s


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    words, names = [f"{a}{b}" for a in ("graph", "deep", "learn", "study", "of", "net") for b in ("", "s", "ing", "er")], ["lee", "li", "smith", "smyth", "garcia", "müller", "muller", "o neil"]
    venues = ["j", "journal of x", "x", "", None, "conf on graphs", "graphs"]

    def one(base=None):
        title = " ".join(rng.choices(words, k=rng.randint(1, 7)))
        if base and base[0] and rng.random() < 0.7:
            shuffled = base[0].split()
            rng.shuffle(shuffled) if rng.random() < 0.3 else None
            title = perturbed(rng, " ".join(shuffled), 4)
        authors = "; ".join(f"{perturbed(rng, rng.choice(names), 1)}, {rng.choice('abc')}." for _ in range(rng.randint(0, 3)))
        return (title if rng.random() < 0.95 else None, base[1] if base and rng.random() < 0.5 else authors or None, rng.choice([None, 1999, 2000, 2001, 2002]), None, rng.choice([None, None, None, "2301.00001"]), rng.choice(venues))

    papers = [one() for _ in range(120)]
    cites = [one(rng.choice(papers)) for _ in range(300)]
    p = spark.createDataFrame([(f"p{i}", *x) for i, x in enumerate(papers)], f"paper_id string, {FIELDS}")
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(cites)], f"citation_id int, {FIELDS}")
    return c, p, Z._prepared(c, "citation_id", "c_").cache(), Z._prepared(p, "paper_id", "p_").cache()


def flat(df) -> list:
    return sorted(str([x if not isinstance(x, float) else round(x, 9) for x in r]) for r in df.collect())


@pytest.mark.parametrize("exact", [False, True])
def test_titles(tables, exact):
    _, _, c, p = tables
    s = Z.title_similarity(F.col("c_title"), F.col("p_title"), exact)
    rows = c.where(F.length("c_title") >= 10).crossJoin(p).withColumn("s", s).where("s > 0.8")
    want = Z._best(rows.select("citation_id", "paper_id", (0.9 * F.col("s")).alias("confidence")), "title")
    got = flat(Z.by_title(c, p, exact=exact))
    assert got == flat(want) and len(got) > 50


def test_authors_and_year(tables):
    _, _, c, p = tables
    rows = c.join(p, F.col("c_year") == F.col("p_year")).withColumn("s", Z.author_similarity(F.col("c_names"), F.col("p_names"))).where("s > 0.7")
    rows = rows.withColumn("s", F.col("s") + F.when(Z.title_similarity(F.col("c_title"), F.col("p_title")) > 0.6, 0.2).otherwise(0.0))
    got = flat(Z.by_author_year(c, p))
    assert got == flat(Z._best(rows.select("citation_id", "paper_id", F.least(0.8 * F.col("s"), F.lit(0.9)).alias("confidence")), "author_year")) and len(got) > 20


def test_combined(tables):
    _, _, c, p = tables
    near = (F.abs(F.col("c_year") - F.col("p_year")) <= 1) & (F.contains("p_venue", F.col("c_venue")) | F.contains("c_venue", F.col("p_venue")))
    rows = c.crossJoin(p).where(near).withColumn("s", Z.combined_score()).where("s > 0.6")
    got = flat(Z.by_combined(c, p))
    assert got == flat(Z._best(rows.select("citation_id", "paper_id", F.least(0.7 * F.col("s"), F.lit(0.8)).alias("confidence")), "combined")) and len(got) > 20


def test_best_of_all_and_simple(tables):
    citations, papers, c, p = tables
    words = lambda x: F.array_distinct(F.split(x, " "))
    both = c.crossJoin(p)
    j = T.jaccard(words("c_title"), words("p_title"))
    named = (F.abs(F.col("c_year") - F.col("p_year")) <= 1) & F.arrays_overlap(T.last_names(F.col("c_names")), T.last_names(F.col("p_names")))
    arxiv = F.when(F.col("c_arxiv") == F.col("p_arxiv"), 0.95)
    some = F.size(F.filter(F.array_intersect(words("c_title"), words("p_title")), lambda w: w != "")) > 0
    score = F.greatest(arxiv, F.when((j > 0.8) & some, 0.8 * j), F.when(named, 0.6))
    assert flat(Z.best_of_all(citations, papers)) == flat(Z._best(both.select("citation_id", "paper_id", score.alias("confidence")).where("confidence > 0.5"), "best").drop("alternatives", "match_type"))
    score = F.greatest(arxiv, F.when(F.col("c_year") == F.col("p_year"), 0.3 + 0.6 * T.jaccard(F.split("c_title", " "), F.split("p_title", " "))))
    assert flat(Z.simple(citations, papers)) == flat(Z._best(both.select("citation_id", "paper_id", score.alias("confidence")).where("confidence > 0.5"), "simple").drop("alternatives", "match_type"))


def test_names_one_to_one(spark):
    rng = random.Random(3)
    names = ["lee a", "lee b", "smith j", "smyth j", "garcia", "garcio"]
    rows = [(rng.choices(names, k=rng.randint(0, 4)), rng.choices(names, k=rng.randint(0, 4))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")

    def plain(a, b):
        free, hits = list(b), 0
        for x in a:
            for y in free:
                if 1 - distance(x, y) / max(len(x), len(y)) > 0.8:
                    free.remove(y)
                    hits += 1
                    break
        return hits / max(len(a), len(b)) if a or b else 0.0

    got = df.select("a", "b", Z.author_similarity(F.col("a"), F.col("b"), one_to_one=True).alias("s")).collect()
    assert [r.s for r in got] == pytest.approx([plain(r.a, r.b) for r in got])
