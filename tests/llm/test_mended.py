"""Other tokenizers, ranges of ids, clashing versions, few labels, loss masks around attachments, a mix that reaches the sequences."""

from __future__ import annotations

import random
import struct
import warnings

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.llm import bin_slack, chat_parts, co_training, queries, seed_extend, token_planes
from papyra.llm.word_ids import WordIds, word_by_word

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def byte_ids():
    return WordIds(queries.tokenizer_path("byte_bpe_50k.json"))


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(list("abZÉß.,!' \n\t\x01<|>क़0")), max_size=40), max_size=5))
def test_other_tokenizers_get_whole_texts(byte_ids, texts):
    assert not byte_ids.by_word and word_by_word(queries.tokenizer_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in byte_ids.encode(texts)] == [byte_ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_ranges_of_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"Word {i} and The cat sat. " * (i % 5), None, None, 0) for i in range(40)], DOCS)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    planes = token_planes.write_token_planes(docs, path, block_ids=50)
    found = {r.start: r.ids for r in planes.ids(0, 10**9).collect()}
    every = [x for _, ids in sorted(found.items()) for x in ids]
    tokenizer = WordIds(path).tokenizer
    assert every == [x for i in range(40) for x in [*tokenizer.encode(f"Word {i} and The cat sat. " * (i % 5), add_special_tokens=False).ids, 1]]
    decoded = []
    monkeypatch.setattr(token_planes, "decode_chunk", lambda d, f=token_planes.decode_chunk: decoded.append(1) or f(d))
    part = sorted((r.start, r.ids) for r in planes.ids(120, 190).collect())
    assert [x for _, ids in part for x in ids] == every[120:190] and part[0][0] == 120


@pytest.mark.parametrize("cut", [3, 10, 20, 40])
def test_damaged_chunks(cut):
    with pytest.raises(ValueError):
        token_planes.decode_chunk(token_planes.encode_chunk(np.arange(500, dtype=np.uint32))[:cut])
    assert struct.calcsize("<4sBBHII") == token_planes.HEAD.size


def test_texts_of_one_id_are_told_apart(spark, monkeypatch):
    """Only the whole hash tells texts of an id apart: many texts under one id, of very different lengths."""
    rng = random.Random(6)
    shared = " ".join(f"s{i}" for i in range(30))
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 400))) + " " + shared for _ in range(300)]
    out = seed_extend.remove_repeats(spark.createDataFrame([(7, t, None, None, 0) for t in texts], DOCS)).collect()
    assert len(out) == 300 and sum(r.n_removed for r in out) >= 299 * 20 and {r.n_words for r in out} == {len(t.split()) for t in texts}


@pytest.mark.parametrize("labelled", [6, 12, 18])
def test_few_labels_still_teach(spark, labelled):
    good, bad = "a calm and clear account of how the river was measured by hand ", "BUY NOW!!! $$$ click click click 777 "
    rows = [(i, (good if i % 2 else bad) * 8 + str(i), "en", "src0", 400) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(labelled)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id: r.keep for r in co_training.score_documents(docs, labels).collect()}
    assert np.mean([kept[i] == bool(i % 2) for i in range(60)]) > 0.95


def test_one_class_warns_and_keeps_all(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "src0", 6) for i in range(10)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id bigint, quality int, toxic int")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert all(r.keep and r.score == 0.5 for r in co_training.score_documents(docs, labels).collect())
    assert any("fewer than two" in str(w.message) for w in said)


def test_attachments_are_not_trained_on(spark):
    parts = [("text", "see ", None, None), ("image", None, "a.png", 2), (None, " ok|", None, None), ("audio", None, "b.wav", 3)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", parts), (1, 2, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts array<{chat_parts.PART}>")
    r = chat_parts.format_chats(df).select("*", chat_parts.loss_text(F.col("segments"), F.col("loss")).alias("trained"), chat_parts.read_parts(F.col("formatted"), F.col("attachments")).alias("back")).first()
    assert r.trained == "see  ok|" and len(r.segments) == len(r.loss) and "".join(r.segments) == r.formatted
    assert [s for s, m in zip(r.segments, r.loss) if m] == ["see ", " ok\\|"]
    assert [[p.kind for p in t.parts] for t in r.back] == [["text", "image", "text", "audio"]] * 2 + [[]]


def test_sequences_follow_the_mix(spark, tmp_path, monkeypatch):
    """Files hold sources one after another; so do the sequences, run by run."""
    monkeypatch.setattr(bin_slack, "WINDOW_SEQUENCES", 4)
    rows = [(i, "word " * (50 + i % 90), None, f"src{i // 300}", 0) for i in range(1200)]
    spark.createDataFrame(rows, DOCS).repartitionByRange(8, "doc_id").write.parquet(f"file://{tmp_path}/mix")
    mixed = spark.read.parquet(f"file://{tmp_path}/mix")
    got = bin_slack.pack_documents(mixed, queries.tokenizer_path(), capacity=512, files_in_order=True).collect()
    apart = bin_slack.pack_documents(mixed, queries.tokenizer_path(), capacity=512).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in apart)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    order = [{r.doc_id // 300 for r in bins[s]} for s in sorted(bins)]
    assert all(max(a) <= min(b) + 0 or max(a) == min(b) for a, b in zip(order, order[1:])) and sorted(bins) == list(range(len(bins)))
    assert len(bins) <= len({r.sequence_id for r in apart}) + bin_slack.MOST_WINDOWS


def test_fit_holds_a_strip_of_doubles():
    """The driver fits on 20,000 rows; copies of them as doubles took it over its memory."""
    import tracemalloc

    from papyra.llm.co_training import Logistic

    rng = np.random.default_rng(1)
    x = rng.normal(size=(20_000, 275)).astype(np.float32)
    y = (x[:, 0] + rng.normal(size=20_000) > 0).astype(float)
    tracemalloc.start()
    model = Logistic().fit(x, y, 1e-3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6
    a = np.hstack([(x - x.mean(0, dtype=float)) / (x.std(0, dtype=float) + 1e-6), np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-(a @ model.w)))
    assert np.abs(a.T @ (p - y) + 1e-3 * len(y) * np.append(model.w[:-1], 0)).max() < 1e-3  # the gradient at the whole fit is none
    assert model.logit(x) == pytest.approx(a @ model.w)


def test_op9_in_slices(spark, monkeypatch):
    """Prefixes, lists, sets and comparisons of a slice at a time give the same components, and no row is lost or counted twice."""
    from papyra.llm import prefix_join

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    whole = sorted(map(tuple, prefix_join.linked(docs).collect()))
    made, store = {}, prefix_join.stored_in_slices

    def counted(make, slices, name):
        made[name] = slices
        return store(make, slices, name)

    monkeypatch.setattr(prefix_join, "stored_in_slices", counted)
    for name, most in (("SLICE_ROWS", 6000), ("SLICE_TEXTS", 100), ("SLICE_SETS", 4)):
        monkeypatch.setattr(prefix_join, name, most)
    assert sorted(map(tuple, prefix_join.linked(docs).collect())) == whole
    assert len({component for *_, component in whole}) < len(whole) and sorted(made) == ["links", "met", "prefixes", "sets"] and min(made.values()) > 1
