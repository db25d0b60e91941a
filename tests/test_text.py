"""Exact values for patterns, normal forms, citations and resolution."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from papyra.functions import scores as S
from papyra.functions import text as T
from papyra.operators import citations as X
from papyra.operators import resolution as Z
from papyra.operators import retrieval as R

FIELDS = "title string, authors string, year int, doi string, arxiv_id string, venue string"
TEXT = (
    "Intro cites [1] and (Smith et al., 2020).\nReferences\n[1] Smith, J. \"A study of graph search\". In Proceedings of Data 2020. doi:10.1000/123\n"
    "[2] Brown, B. \"Deep networks at scale\". arXiv:2301.12345\n[3] Lee, G. \"Citation counts revisited\". Journal 2019. https://doi.org/10.5678/abcdef\n"
)

PAPERS = [
    ("w1", "Tidal Flats and Their Birds", "Okafor, P.; Lind, S.", 2011, "10.5555/tides", None, "Coast Letters"),
    ("w2", "Slow Rivers", "Moreau, C.; Iyer, T.", 2014, None, "1402.00017", "Hydrology"),
    ("w3", "Maps of Forgotten Harbours", "Quist, R.; Abe, N.", 2009, "10.5555/maps", None, "Atlas"),
    ("w4", "Salt in Old Timber", "Novak, J.; Reyes, L.", 2016, None, None, "Timber"),
    ("w5", "Lighthouse Keeping Practice", "Berg, H.; Sato, K.", 2018, None, None, "Signals"),
]
CITED = [
    (1, "Another Title", None, 2011, "10.5555/TIDES", None, None), (2, "Rivers", None, None, None, "1402.00017", None), (3, "The Maps of Forgotten Harbour", None, 2009, None, None, None),
    (4, "Unknown", "Novak, J.; Reyes, L.", 2016, None, None, None), (5, "Lighthouse Keeping Practices", "Berg, H.", 2017, None, None, "Signals"), (6, "Not There", "Nobody, N.", 1980, None, None, None),
]


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("doi:10.1000/123", "10.1000/123"), ("DOI: 10.1234/567890", "10.1234/567890"), ("https://doi.org/10.5678/abcdef", "10.5678/abcdef"), ("http://dx.doi.org/10.9999/test", "10.9999/test"), ("No DOI here", None)],
)
def test_doi(spark, text, want):
    assert one(spark, text, T.doi) == want


@pytest.mark.parametrize(("text", "want"), [("arXiv:2301.12345", "2301.12345"), ("arxiv:2201.67890v2", "2201.67890v2"), ("arXiv:cs.AI/0701123", "cs.AI/0701123"), ("arxiv:math.GT/9901001v1", "math.GT/9901001v1"), ("none", None)])
def test_arxiv(spark, text, want):
    assert one(spark, text, T.arxiv_id) == want


@pytest.mark.parametrize(("text", "want"), [("Journal 2023.", 2023), ("(2020)", 2020), (", 1995", 1995), ("Paper 2030", 2030), ("Too old 1800", None), ("Too future 2050", None)])
def test_year(spark, text, want):
    assert one(spark, text, T.year) == want


@pytest.mark.parametrize(("text", "want"), [("The Machine Learning Analysis", "machine learning analysis"), ("Machine Learning Analysis (Extended Version)", "machine learning analysis")])
def test_title(spark, text, want):
    assert one(spark, text, T.normalize_title) == want


def test_authors_split_on_semicolons(spark):
    assert one(spark, "Smith, J.; Jones, A.", T.author_names) == ["smith j", "jones a"]


def test_entries_and_fields(spark):
    rows = X.parse(X.explode_entries(spark.createDataFrame([("d1", TEXT)], "source_paper_id string, text string"))).orderBy("position").collect()
    assert [r.doi for r in rows] == ["10.1000/123", None, "10.5678/abcdef"]
    assert [r.arxiv_id for r in rows] == [None, "2301.12345", None]
    assert rows[0].title == "A study of graph search" and rows[0].year == 2020 and rows[0].authors == "Smith, J."


def test_resolution_takes_the_first_stage_that_finds(spark):
    found = {r.citation_id: (r.paper_id, r.match_type) for r in Z.resolve(spark.createDataFrame(CITED, f"citation_id int, {FIELDS}"), spark.createDataFrame(PAPERS, f"paper_id string, {FIELDS}")).collect()}
    assert found[1] == ("w1", "doi") and found[2] == ("w2", "arxiv") and found[3] == ("w3", "title") and found[4] == ("w4", "author_year")
    assert found[5][0] == "w5" and 6 not in found


def test_exact_sequence_ratio(spark):
    c, p = spark.createDataFrame(CITED[2:3], f"citation_id int, {FIELDS}"), spark.createDataFrame(PAPERS, f"paper_id string, {FIELDS}")
    assert Z.resolve(c, p, exact=True).first().paper_id == "w3"


@pytest.mark.parametrize("exact", [False, True])
def test_titles_of_common_words_meet(spark, exact):
    """Every word of the right title is in over 64 others, the citation's slip is a word of another paper, and one shares no word."""
    rng, words = random.Random(2), "causal inference for neural networks of graphs and trees in deep learning".split()
    titles = ["Causal inference for neural networks", "Casual dress codes", "Astronomy spectra", *(" ".join(rng.choices(words, k=6)) for _ in range(400))]
    asked = ["Casual inference for neural networks", "Astronomi spectre", *(" ".join(w[:-1] if rng.random() < 0.3 else w for w in rng.choice(titles[3:]).split()) for _ in range(20))]
    c = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "citation_id int, c_title string").withColumn("c_title", F.lower("c_title"))
    p = spark.createDataFrame([(f"p{i}", x) for i, x in enumerate(titles)], "paper_id string, p_title string").withColumn("p_title", F.lower("p_title"))
    every = c.crossJoin(p).where(Z.title_similarity(F.col("c_title"), F.col("p_title"), exact) > 0.8).select("citation_id", "paper_id")
    got = Z.by_title(c, p, exact=exact).select("citation_id", F.explode(F.concat(F.array("paper_id"), "alternatives")).alias("paper_id"))
    want = {tuple(r) for r in every.collect()}
    assert {tuple(r) for r in got.collect()} == want and (0, "p0") in want and (exact or (1, "p2") in want)


def test_validation_of_citations(spark):
    r = R.validate_citations(spark.createDataFrame([("[arxiv:1706.03762] [missing:citation]", ["arxiv:1706.03762"])], "answer string, available array<string>")).first()
    assert (r.valid, r.missing, r.coverage) == (["arxiv:1706.03762"], ["missing:citation"], 0.5)


def test_points_unlike_each_other(spark):
    points = ["the quick brown fox jumps", "the quick brown fox jumps", "an entirely different point here", "short"]
    assert one(spark, points, R.distinct_points, "array<string>") == ["the quick brown fox jumps", "an entirely different point here"]


def test_links_replace_all_forms(spark):
    df = spark.createDataFrame([("a [arxiv:1] b (arxiv:1) c arxiv:1", ["arxiv:1"], ["X"])], "a string, i array<string>, s array<string>")
    assert df.select(T.link_citations(F.col("a"), F.col("i"), F.col("s"))).first()[0] == "a X b X c X"


def test_weighted_score_over_present_parts(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(S.present_weighted((F.col("a"), 0.4), (F.col("b"), 0.6))).collect()] == [1.0, None]


def test_backoff_is_bounded(spark):
    assert [one(spark, n, T.backoff, "int") for n in (0, 3, 10)] == [1.0, 8.0, 60.0]


def test_section_without_headers_is_one(spark):
    assert [r.title for r in X.sections(spark.createDataFrame([(1, "plain line.\nmore text here.")], "id int, text string"), "id").collect()] == ["Full Document"]


def test_a_doi_ends_with_its_line(spark):
    assert one(spark, "doi:10.1000/abc\r\nnext", T.doi) == "10.1000/abc"


def test_cleaned_titles_and_authors(spark):
    assert one(spark, "Title:  Slow\n Rivers (draft)", T.clean_title) == "Slow Rivers"
    assert one(spark, " Lind, S.,  Iyer, T. , ", T.clean_authors) == "Lind, S., Iyer, T"


@pytest.mark.parametrize(("text", "want"), [("[12] Lind, S. (2011). DOI 10.5/x", "lind s. 2011 . doi:10.5 x"), ("See https://a.org/b", "see https: a.org b"), ("", ""), (None, None)])
def test_normal_form_of_citations(spark, text, want):
    assert one(spark, text, T.normalize_citation) == want


@pytest.mark.parametrize(("text", "want"), [(' "deep\nlearning" ', "deep learning"), ("asked", None), ("''", None), (None, None)])
def test_cleaned_answers(spark, text, want):
    assert one(spark, text, lambda c: T.clean_answer(c, F.lit("asked"))) == want


def test_head_of_a_page(spark):
    page = "\n  arXiv:1402.00017 preprint\n\nShort\nSlow Rivers of the North\n---\nC. Moreau, T. Iyer and K. Sato, University of Tides & Q\nAbstract"
    assert one(spark, page, lambda c: X.page_title(X.head_lines(c))) == "Slow Rivers of the North"
    assert one(spark, page, lambda c: X.page_authors(X.head_lines(c))) == ["C. Moreau", "T. Iyer", "K. Sato"]
    for empty in ("", None, "Short"):
        assert one(spark, empty, lambda c: X.page_title(X.head_lines(c))) is None and one(spark, empty, lambda c: X.page_authors(X.head_lines(c))) is None


def test_references_to_the_appendix_or_the_end(spark):
    body = "Lind, S. Tidal flats. " * 6
    assert one(spark, f"Text\nReferences:\n{body}\nAppendix A", X.references) == body.strip()
    assert one(spark, f"Text\nBibliography\n{body}", X.references) == body.strip()
    assert one(spark, "References\nshort", X.references) is None
