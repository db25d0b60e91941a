"""Chunks by meaning against all cuts; summaries in levels against a plain version."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.operators import chunking as C
from papyra.operators import summaries as M


def price(tokens, alike, firsts, size, least):
    total = sum(1 + alike[i - 1] for i in firsts if i)
    for a, b in zip(firsts, [*firsts[1:], len(tokens)]):
        n = sum(tokens[a:b])
        if b - a > 1 and n > size:
            return None
        total += C.SHORT if n < least else 0
    return total


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9), st.randoms(), st.integers(5, 25), st.integers(0, 6))
def test_boundaries_are_the_cheapest(tokens, rng, size, least):
    alike = [rng.choice([0.0, 0.25, 0.5, 1.0, -0.5]) for _ in tokens[1:]]
    got = C.best_boundaries(tokens, alike, size, least)
    cuts = [(0, *c) for n in range(len(tokens)) for c in combinations(range(1, len(tokens)), n)]
    prices = [p for p in (price(tokens, alike, list(c), size, least) for c in cuts) if p is not None]
    assert price(tokens, alike, got, size, least) == pytest.approx(min(prices))


def topics(sentences):
    """A vector for each first word: sentences of one topic are alike."""
    return np.array([[1.0, 0.0] if s.startswith("cat") else [0.0, 1.0] for s in sentences]).reshape(-1, 2)


def test_cuts_where_topics_change(spark):
    text = " ".join(["cat eats fish."] * 4 + ["dog runs far."] * 5)
    rows = [(1, 0, "A Title!", text), (1, 1, "B", "cat sat. dog ran."), (2, 0, "C", None), (2, 1, "D", " \n"), (3, 0, "E", "word " * 40 + "end.")]
    df = spark.createDataFrame(rows, "doc_id bigint, section int, title string, content string")
    got = [(r.doc_id, r.section, r.chunk_index, r.token_count, r.chunk_id) for r in C.semantic_chunks(df, "doc_id", 15, 3, topics).orderBy("doc_id", "section", "chunk_index").collect()]
    assert got == [(1, 0, 0, 12, "1_A_Title_0"), (1, 0, 1, 15, "1_A_Title_1"), (1, 1, 0, 4, "1_B_0"), (3, 0, 0, 41, "3_E_0")]
    mixed = [(r.doc_id, r.section, r.token_count) for r in C.semantic_chunks(df, "doc_id", 15, 3, topics, hybrid=True, overlap=5).orderBy("doc_id", "section", "chunk_index").collect()]
    assert mixed == [(1, 0, 12), (1, 0, 15), (1, 1, 4), (3, 0, 15), (3, 0, 15), (3, 0, 15), (3, 0, 11)]
    assert C.semantic_chunks(df.limit(0), "doc_id").count() == 0


def plain_summary(texts, model, words, budget):
    parts = [p for t in texts for p in ([" ".join(t.split()[i : i + budget]) for i in range(0, len(t.split()), budget)] if len(t.split()) > budget else [t])]
    level, levels, fan = [" ".join(x.split()[:words]) for x in model(parts)], 0, budget // words
    while len(level) > 1:
        groups = [[x for x in level[i : i + fan] if x] for i in range(0, len(level), fan)]
        level = [" ".join(model(["\n\n".join(g)])[0].split()[:words]) if len(g) > 1 else (g or [""])[0] for g in groups]
        levels += 1
    return level[0], levels


def test_summary_in_levels(spark):
    rng, rows = random.Random(4), []
    docs = {d: [" ".join(rng.choice(["alpha beta gamma delta epsilon.", "one two three four five six.", "x."]) for _ in range(rng.randint(0, 12))) for _ in range(n)] for d, n in enumerate([1, 2, 5, 26, 130])}
    docs[5] = ["", ""]
    docs[6] = ["long sentence without any end " * 60 + ". And a proper ending of this text here."]
    rows = [(d, 7 * i, t or None) for d, texts in docs.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, chunk_index int, content string")
    model = M.first_sentences(20)
    got = {r.doc_id: (r.summary, r.levels) for r in M.summarize(df, model, 20, 100).collect()}
    assert got == {d: plain_summary(texts, model, 20, 100) for d, texts in docs.items()}
    assert got[4][1] == 4
    assert M.summarize(df.limit(0), model, 20, 100).count() == 0
    with pytest.raises(ValueError):
        M.summarize(df, model, 20, 30)


def test_components_and_points(spark):
    rows = [(1, 2, "Our Method", "m" * 600), (1, 1, "Approach", "first"), (1, 3, "Results", None), (1, 4, "Evaluation", "ev"), (2, 1, None, "no title")]
    got = {r.doc_id: (r.methodology, r.results, r.conclusions) for r in M.components(spark.createDataFrame(rows, "doc_id int, section int, title string, content string")).collect()}
    assert got == {1: ("first...", "", ""), 2: ("", "", "")}
    df = spark.createDataFrame([("intro\n- one\n* two\n• three\n1. four\n2. five\n3. six",)], "s string")
    assert df.select(M.key_points(df.s)).first()[0] == ["one", "two", "three", "four", "five"]


def test_sentences_of_few_sections_at_a_time(spark):
    from papyra.operators import chunking

    def encode(sentences):
        assert len(sentences) <= 2 * 64
        return chunking.hashed_vectors(sentences)

    rows = spark.createDataFrame([(i, 0, "t", f"one {i}. two {i}.") for i in range(500)], "doc_id bigint, section int, title string, content string").coalesce(1)
    assert chunking.semantic_chunks(rows, "doc_id", 200, 1, encode).select("doc_id").distinct().count() == 500
