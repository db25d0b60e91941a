"""Stems as published, in Spark and in SQL; the search gives what scoring everything gives and reads less."""

from __future__ import annotations

import math
import random
import re
import uuid

from pyspark.sql import functions as F

from papyra.functions import stems as S
from papyra.functions import text as T
from papyra.operators import fulltext as X

#: Examples of the published algorithm.
WORDS = "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing failing filing happy sky relational conditional rational digitizer vietnamization operator feudalism hopefulness sensibiliti triplicate formalize electrical goodness revival airliner adjustable replacement adoption activate rate controll generalizations by"
STEMS = "caress poni ti cat feed agre plaster motor sing conflat troubl size hop fall hiss fail file happi sky relat condit ration digit vietnam oper feudal hope sensibl triplic formal electr good reviv airlin adjust replac adopt activ rate control gener by"


def test_stems(spark):
    import duckdb

    df = spark.createDataFrame([(w,) for w in WORDS.split()], "w string")
    assert [r[0] for r in df.select(S.stem(df.w)).collect()] == STEMS.split()
    con = duckdb.connect()
    con.execute("CREATE TABLE words_ AS SELECT unnest(?) AS word", [WORDS.split()])
    assert dict(con.execute(S.stem_sql("word")).fetchall()) == dict(zip(WORDS.split(), STEMS.split()))


def test_search_equals_all_scores_and_reads_less(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 16)
    rng = random.Random(2)
    words = ["running", "runs", "graph", "graphs", "index", "the", "deep", "deeply", "zeta"]
    docs = [(d, " ".join(rng.choices(words, weights=[9, 9, 5, 5, 3, 9, 1, 1, 0.2], k=rng.choice([3, 8, 40, 200]))) if d % 50 else None) for d in range(600)]
    questions = [(1, "graph"), (2, "Running graphs"), (3, "deep index graph"), (4, "the"), (5, "nothing graph"), (6, "zeta deeply"), (7, None)]
    index = X.TextIndex.build(spark.createDataFrame(docs, "doc_id int, text string"), f"file://{tmp_path}/{uuid.uuid4().hex}")
    found = index.search(spark.createDataFrame(questions, "query_id bigint, query string"), 5)
    got = {(r.query_id, r.rank): (r.id, round(r.score, 9)) for r in found.collect()}
    stem = {w: s for w, s in zip(words, [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(S.stem(F.col("w"))).collect()])}
    stem |= {"nothing": "noth"}
    want = {}
    for q, text in questions:
        asked = {stem[w] for w in re.findall(r"\w+", (text or "").lower()) if w not in T.STOP_WORDS}
        scored = []
        for d, t in docs:
            own = (t or "").split()
            held = [stem[w] for w in own if w not in T.STOP_WORDS]
            if asked and asked <= set(held):
                scored.append((-round(sum(held.count(a) / (1 + math.log(len(own))) for a in asked), 9), d))
        want |= {(q, i + 1): (d, -s) for i, (s, d) in enumerate(sorted(scored)[:5])}
    assert {k: (i, round(s, 6)) for k, (i, s) in got.items()} == {k: (i, round(s, 6)) for k, (i, s) in want.items()}
    assert 0 < index.postings_read < 0.6 * index.postings_held


def test_empty_index(spark, tmp_path):
    index = X.TextIndex.build(spark.createDataFrame([(1, None), (2, " .")], "doc_id int, text string"), f"file://{tmp_path}/e")
    assert index.search(spark.createDataFrame([(1, "graph")], "query_id bigint, query string"), 3).count() == 0


def test_postings_are_counted_where_documents_are(spark, capsys):
    """One exchange, of texts by document; none of the rows of their terms."""
    from papyra.plans.records import postings

    found = postings(spark, "/root/testdata/sf0.001")
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(doc_id" in plan and "doc_id#" in plan and "term" not in plan.split("Exchange")[1].splitlines()[0]


def test_words_are_stemmed_once_and_postings_made_where_documents_are(spark, tmp_path, monkeypatch):
    """The stem of a word is that of the expressions; documents travel to their range, postings don't; repeated rows of an id are one document."""
    words = WORDS.split() + ["", "a", "as", "ponies2", "straße", "études", "ated", "ing", "yes"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [S.stem_of(w) for w in words] == [r[0] for r in df.select(S.stem(df.w)).collect()]
    docs = spark.createDataFrame([(1, "graphs of running"), (1, "graphs of running"), (2, "Graph, the graph"), (3, "the of"), (4, None)], "doc_id int, text string")
    index = X.TextIndex.build(docs, f"file://{tmp_path}/{uuid.uuid4().hex}")
    blocks = {(r.term, d): w for r in index._read(list(range(X.BUCKETS))).collect() for d, w in zip(r.ids, r.weights)}
    want = {("graph", 1): 2 / (1 + math.log(3)), ("run", 1): 2 / (1 + math.log(3)), ("graph", 2): 2 / (1 + math.log(3))}
    assert blocks.keys() == want.keys() and all(abs(blocks[k] - v) < 1e-12 for k, v in want.items())
