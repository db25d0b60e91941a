"""Phrases of many small chunks against DuckDB, over random texts with odd rows; packing; exact scores beyond 64 bits."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import phrase_lists as P

SCHEMA = "text string, lang string, key string, f string, n string, rank string, chunk string"
SMALL = P.PhraseSetting(least=4, words=5, top=25)


def texts(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words, rows = ["a", "B", "b", "É", "dd", "e-e", " x", "<|y|>"], []
    for _ in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        rows.append(("".join(x + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "!?", "\x0b"]) for x in w), rng.choice(["en", "en", "en", None, "", "de", "und"])))
    rows += [(None, "en"), ("", None), (" .,;:!?\n", "en"), ("solo", "fr"), ("a b " * 500, "en"), ("w" * 5000 + " a b", "en")]
    return rows + rows[:20]


def duck(rows: list[tuple], s: P.PhraseSetting) -> list[tuple]:
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"text": pd.Series([t for t, _ in rows], dtype="object"), "lang": pd.Series([x for _, x in rows], dtype="object")}))
    return con.execute(P.oracle_sql(s)).fetchall()


@pytest.mark.parametrize("seed, chunk, room", [(1, 100, 20_000), (2, 1 << 20, 30)])
def test_equals_sql(spark, monkeypatch, seed, chunk, room):
    monkeypatch.setattr(P, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(P, "RANK_ROWS", room)
    rows = texts(seed)
    df = spark.createDataFrame([(*r, *"12345") for r in rows], SCHEMA).repartition(3)
    got = P.collocations(df, SMALL)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(duck(rows, SMALL), key=str) != []


def test_no_rows_and_nothing_frequent(spark):
    df = spark.createDataFrame([("a b c", None, *"12345")], SCHEMA)
    assert P.collocations(df, SMALL).count() == 0
    assert P.collocations(df.limit(0), SMALL).count() == 0


def test_ranks_in_shares(spark):
    """Ever fewer shares rank as one task would."""
    rng = random.Random(3)
    rows = [("en" if i % 3 else "de", f"p{i}", rng.randint(4, 9), rng.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, phrase string, a bigint, score bigint")
    s = P.PhraseSetting(top=7)
    P.RANK_ROWS, held = 40, P.RANK_ROWS
    try:
        got = {(r.lang, r.rank, r.phrase) for r in P._first_ranks(df, s).collect()}
    finally:
        P.RANK_ROWS = held
    want = {(x, i + 1, p) for x in ("en", "de") for i, (_, _, p) in enumerate(sorted((-v, -a, p) for lang, p, a, v in rows if lang == x)[:7])}
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50), st.lists(st.integers(-(2**31), 2**31 - 1), max_size=50))
def test_pack_goes_round(a, b):
    x, y = P.unpack(P.pack(np.array(a, np.uint64), np.array(b, np.int32)), np.uint64, np.int32)
    assert x.tolist() == a and y.tolist() == b


def test_lists_hold_every_place():
    keys, places = np.array([5, 3, 5, 5, 9], np.uint64), np.array([0, 1, 4, 7, 9], np.int32)
    lists, _ = P.Lists.of(keys, places)
    again = P.Lists.unpack(lists.pack())
    assert again.keys.tolist() == [3, 5, 9] and again.lengths.tolist() == [1, 3, 1] and again.starts.tolist() == [1, 0, 4, 7, 9]
    assert again.firsts().tolist() == [1, 0, 9]
    assert [x.tolist() for x in again.by_place(np.array([1, 2]))] == [[0, 4, 7, 9], [1, 1, 1, 2]]


def test_pairs_and_lists_come_back_from_their_steps():
    rng = np.random.default_rng(5)
    for top in (1, 3, 1 << 63):
        prefix, word = rng.integers(0, top, 500, dtype=np.uint64), rng.integers(0, top, 500, dtype=np.uint64)
        order = np.lexsort((word, prefix))
        again = P.pairs_of(*P.pair_steps(prefix[order], word[order]))
        assert (again[0] == prefix[order]).all() and (again[1] == word[order]).all()
        lists = P.Lists.of(prefix, np.arange(7, 507, dtype=np.int32))[0]
        back = P.Lists.unpack(lists.pack())
        assert all((getattr(back, n) == getattr(lists, n)).all() for n in ("keys", "lengths", "starts"))
    none = np.zeros(0, np.uint64)
    assert not any(len(x) for x in P.pairs_of(*P.pair_steps(none, none)))
