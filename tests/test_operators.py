"""Filters, upserts, vectors, fusion and chunks against hand values and plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra import plans
from papyra.functions import text as T
from papyra.operators import chunking as C
from papyra.operators import filters as P
from papyra.operators import graph as G
from papyra.operators import retrieval as R
from papyra.operators import upserts as U
from papyra.operators import vectors as V


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_exists_ignores_absent_keys(spark):
    known = spark.createDataFrame([("a", None), (None, "h2")], "id string, hash string")
    asked = spark.createDataFrame([("a", "x"), ("b", "h2"), ("c", None), (None, None)], "id string, hash string")
    assert rows(P.exists_by_any_key(asked, known, ["id", "hash"]), "id", "exists") == sorted([("a", True), ("b", True), ("c", False), (None, False)], key=str)


def test_insert_keeps_one_of_each_key(spark):
    known = spark.createDataFrame([(1, "h1")], "id int, hash string")
    new = spark.createDataFrame([(2, "h1"), (3, "h3"), (4, "h3"), (5, None), (3, "h9")], "id int, hash string")
    assert rows(U.insert_if_new(new, known, ["hash", "id"], [F.col("id")]), "id") in ([(3,), (5,)], [(3,), (5,), (3,)])


def test_upsert_and_update(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    assert rows(U.upsert(old, new, ["k"], [F.desc("seq")]), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(U.update_columns(old, spark.createDataFrame([(1, None), (2, "z")], "k int, v string"), "k"), "k", "v") == [(1, "a"), (2, "z")]


def test_pairs_go_both_ways_once(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "b"), ("a", "c")], "a string, b string")
    assert rows(U.both_ways(df), "a", "b") == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]


def test_retention(spark):
    df = spark.createDataFrame([(i, i) for i in range(20)], "id int, ts int")
    assert rows(U.retain(df, "ts", F.lit(18), 5, [F.desc("ts"), F.col("id")]), "id") == sorted([(i,) for i in range(15, 20)], key=str)


def test_retention_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(1, 20), (1, 20), (2, 5), (2, 5), (3, 1), (4, None)], "id int, ts int")
    assert rows(U.retain(df, "ts", F.lit(18), 4, [F.desc("ts"), F.col("id")]), "id") == [(1,), (1,), (2,), (2,)]
    assert rows(U.retain(df, "ts", F.lit(18), 1, [F.desc("ts"), F.col("id")]), "id") == [(1,), (1,)]


def test_fallback_takes_only_what_is_missing(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(3,), (4,)], "k int")
    assert rows(U.fill_from(a, b, 3, ["k"]), "k") == [(1,), (2,), (3,)]


def test_metadata_filter(spark):
    df = spark.createDataFrame([("Graph", 1), ("graphs", 2), ("tree", 1)], "t string, n int")
    assert rows(P.metadata_filter(df, {"t": "GRAPH", "n": [1], "missing": 3}), "t") == [("Graph",)]


def test_integrity(spark):
    e = spark.createDataFrame([(1, 0.5), (2, 1.5), (None, 0.1)], "k int, s double")
    d = spark.createDataFrame([(1,)], "id int")
    assert rows(P.integrity_issues(e, {"k": (d, "id")}, "s", 0, 1), "issue", "n") == [("dangling_k", 2), ("range_s", 1)]


def test_constant_list_normalises_to_one(spark):
    df = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.4), (2, 1, 1.0), (2, 2, 3.0)], "query_id int, id int, score double")
    assert rows(R.min_max(df), "query_id", "score") == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 1.0)]


def test_fusion_scores_absent_as_zero(spark):
    d = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "b", 0.1)], "query_id int, rank int, id string, score double")
    s = spark.createDataFrame([(1, 1, "c", 5.0)], "query_id int, rank int, id string, score double")
    assert [(r.id, round(r.score, 6)) for r in R.fuse(d, s, 3).orderBy("rank").collect()] == [("a", 0.7), ("c", 0.3), ("b", 0.0)]


def test_budget_cites_the_first_overflow(spark):
    df = spark.createDataFrame([(1, k, 40) for k in range(1, 6)], "query_id int, rank int, n int")
    assert rows(R.context_budget(df, F.col("n"), 100), "rank", "in_context") == [(1, True), (2, True), (3, False)]


def test_restricted_retrieval_fills_up(spark):
    a = spark.createDataFrame([(1, 1, "a", 0.9)], "query_id int, rank int, id string, score double")
    b = spark.createDataFrame([(1, 1, "a", 5.0), (1, 2, "b", 4.0), (1, 3, "c", 3.0)], "query_id int, rank int, id string, score double")
    assert [r.id for r in R.first_then(a, b, 2).orderBy("rank").collect()] == ["a", "b"]


def test_bm25_prefers_the_rarer_word(spark):
    docs = spark.createDataFrame([(1, "attention mechanism in networks"), (2, "networks of trains"), (3, "trains and cars"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "attention mechanism")], "query_id int, query string")
    hits = R.bm25(docs, asked, 2).collect()
    assert [h.id for h in hits] == [1] and hits[0].score > 0


@pytest.fixture(scope="module")
def vectors(spark):
    m = np.random.default_rng(1).normal(size=(300, 8))
    return m, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id bigint, embedding array<double>")


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_search_equals_numpy(vectors, metric, monkeypatch):
    m, df = vectors
    monkeypatch.setattr(V, "BLOCK", 64)
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = {"cosine": n @ n.T, "ip": m @ m.T, "l2": -np.linalg.norm(m[:, None] - m[None], axis=2)}[metric].copy()
    np.fill_diagonal(s, -np.inf)
    want = sorted((q, int(i)) for q in range(0, 300, 50) for i in np.argsort(-s[q])[:5])
    assert sorted((r.query_id, r.id) for r in V.search(df.where("vec_id % 50 = 0"), df, 5, metric).collect()) == want


def test_nearest_groups_beyond_the_own_one(spark, monkeypatch):
    """Hundreds of near-copies have the query's label, and other groups are large too."""
    monkeypatch.setattr(V, "BLOCK", 64)
    rng = np.random.default_rng(4)
    m, label = rng.normal(size=(400, 6)), rng.choice([1, 2, 3, 4, 5, 6], 400, p=[0.3, 0.3, 0.3, 0.04, 0.03, 0.03])
    m[:150], label[:150] = m[0] + rng.normal(size=(150, 6)) / 1000, 9
    df = spark.createDataFrame([(i, [float(x) for x in v], int(g)) for i, (v, g) in enumerate(zip(m, label))], "vec_id bigint, embedding array<double>, label int")
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = []
    for q in range(0, 400, 50):
        s = n @ n[q]
        best = sorted((-max(s[label == g]), g) for g in set(label) - {label[q]})[:5]
        want += [(q, k + 1, int(g), int(np.flatnonzero(label == g)[s[label == g].argmax()])) for k, (_, g) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.label, r.id) for r in V.search_groups(df.where("vec_id % 50 = 0"), df, 5).collect()) == sorted(want)


def test_multiples_of_a_vector_tie_as_in_sql(spark, tmp_path):
    """Eight vectors of whole numbers, each with five multiples of other labels: fewer rows than the SQL ranks, so it is whole here."""
    import duckdb

    m = np.random.default_rng(5).integers(-40, 40, size=(8, 64))
    data = [(100 * i + j, [float(x) for x in (2 * j + 1) * v], (i + j) % 10) for i, v in enumerate(m) for j in range(6)]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = rows(plans.queries()["similar_one_per_group"](spark, str(tmp_path)), "query_id", "rank", "label", "id", "score")
    assert [(q, rank, i) for q, rank, _, i, score in sorted(got) if score == 1] == [(100 * i, j, 100 * i + j) for i in range(8) for j in range(1, 6)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(plans.oracle_sql()["similar_one_per_group"]).fetchall(), key=str)


def test_pairs_equal_numpy(vectors, monkeypatch):
    m, df = vectors
    monkeypatch.setattr(V, "BLOCK", 64)
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(n @ n.T >= 0.8)) if i < j}
    assert {(r.a, r.b) for r in V.similar_pairs(df, 0.8).collect()} == want
    assert {(r.a, r.b) for r in V.lsh_pairs(df, 0.5).collect()} <= {(i, j) for i in range(300) for j in range(i + 1, 300)}


def test_each_pair_once_in_every_block(vectors, monkeypatch):
    m, df = vectors
    monkeypatch.setattr(V, "BLOCK", 32)
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = sorted((int(i), int(j)) for i, j in zip(*np.nonzero(n @ n.T >= 0.8)) if i < j)
    assert sorted((r.a, r.b) for r in V.similar_pairs(df, 0.8).collect()) == want


def test_nearest_rows_of_two_blocks_in_little_memory():
    import tracemalloc

    m = np.random.default_rng(3).normal(size=(4096, 16))
    m[100:200] = m[0]  # ties go to the smaller id
    tracemalloc.start()
    q, c, s = V.best_rows(m, np.arange(4096), m, np.arange(4096), 5, "l2")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and len(q) == 5 * 4096
    assert c[:5].tolist() == [100, 101, 102, 103, 104] and not s[:5].any()
    assert c[5 * 150 : 5 * 150 + 5].tolist() == [0, 100, 101, 102, 103]


def test_links_have_the_components_of_all_pairs(vectors, monkeypatch):
    m, df = vectors
    monkeypatch.setattr(V, "BLOCK", 32)
    both = [V.similar_pairs(df, 0.8), V.similar_links(df, 0.8)]
    a, b = ({(r.node, r.component, r.size) for r in G.communities(x.selectExpr("a as src", "b as dst")).collect()} for x in both)
    assert a == b and both[1].count() < both[0].count()


def test_lsh_pairs_are_those_of_the_bucket_join(vectors, monkeypatch):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    m, df = vectors
    monkeypatch.setattr(V, "BLOCK", 32)
    rows = df.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=0.5, numHashTables=2, seed=42).fit(rows)
    want = model.approxSimilarityJoin(rows, rows, 2.0, "d").selectExpr("datasetA.vec_id a", "datasetB.vec_id b").where("a < b")
    found = V.lsh_pairs(df, 2.0, tables=2)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()  # no join of each bucket with itself
    assert sorted((r.a, r.b) for r in found.collect()) == sorted((r.a, r.b) for r in want.collect())


@pytest.mark.parametrize("rank", [R.bm25, R.tfidf])
def test_ranking_shuffles_no_terms_of_documents(spark, monkeypatch, rank):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 397}" for j in range(1, 20))) for i in range(400)], "doc_id bigint, text string").repartition(8).cache()
    asked = spark.createDataFrame([(q, f"w{q} w{q + 7} w3") for q in range(1, 9)], "query_id int, query string")
    one = rank(docs, asked, 5)
    assert "hashpartitioning(id" not in one._jdf.queryExecution().toString()
    monkeypatch.setattr(R, "ASKED", 3)
    monkeypatch.setattr(R, "DOCS", 50)
    rows = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    assert rows(one) == rows(rank(docs, asked, 5)) and rows(one)


def test_clusters_and_embeddings(vectors, spark):
    _, df = vectors
    assert V.kmeans(df, 4).select("cluster").distinct().count() <= 4
    e = V.embed(spark.createDataFrame([(1, "a b c a"), (2, "")], "id int, t string"), T.words(F.col("t")), 16)
    assert [round(sum(x * x for x in r.embedding), 6) for r in e.orderBy("id").collect()] == [1.0, 0.0]


def test_token_windows_cover_the_text(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(50)))), (2, ""), (3, "one two")], "doc_id int, text string")
    got = rows(C.token_windows(df, 20, 5, 3), "doc_id", "chunk_index", "token_count")
    assert got == [(1, 0, 20), (1, 1, 20), (1, 2, 20), (3, 0, 2)]


def test_sentences_pack_within_the_limit(spark):
    text = "First sentence here. Second one is a bit longer. " * 10 + "\n\n" + "x" * 250
    out = C.pack_sentences(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"), 100).collect()
    assert all(len(r.content) <= 100 for r in out) and {r.doc_id for r in out} == {1} and sum(r.content.count("x") for r in out) == 250


def test_rewrite_limits_terms(spark):
    q = spark.createDataFrame([(1, "Neural network attention on the state of the art"), (2, "plain"), (3, "transformer evaluation on a dataset")], "id int, query string")
    a, b, c = R.rewrite(q).orderBy("id").collect()
    assert a.rewritten == "neural network attention on the state-of-the-art deep learning multilayer perceptron self-attention" and b.rewritten == "plain"
    assert c.added == ["attention mechanism", "self-attention", "multi-head attention", "BERT", "GPT", "assessment", "validation", "testing"]
