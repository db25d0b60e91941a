"""Nulls, empty tables and texts, ties, repeated rows, clashing columns; and each method against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.llm import audio_features as A
from papyra.llm import bin_slack as B
from papyra.llm import chat_parts as C
from papyra.llm import co_training as Q
from papyra.llm import norm_topk as N
from papyra.llm import pfair as M
from papyra.llm import prefix_join as J
from papyra.llm import queries, seed_extend, token_planes
from papyra.llm import url_vocabulary as U
from papyra.llm.word_ids import WordIds, crc32_combine

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, d string, v string, token string, key string, slot string, a string, w string"
EXTRA = ("x", "y", "z", "k", "s", "q", "p")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Every awkward row at once; the columns after n_chars are named like our own."""
    texts = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (None, "no id here"), (4, LONG), (5, LONG), (6, LONG + " tail"), (7, "a b"), (8, "A B"), (9, "\x01 \x1c é <|endoftext|> \u0958.")]
    rows = [(d, t, None if d == 2 else "en", None if d == 7 else f"src{(d or 0) % 2}", None if t is None else len(t), *EXTRA) for d, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_token_planes(odd, none):
    rows = token_planes.write_token_planes(odd, queries.tokenizer_path()).documents().collect()
    assert len(rows) == odd.count() and sorted(r.start for r in rows)[0] == 0
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert next(r.start for r in rows if r.doc_id is None) == 0
    assert token_planes.write_token_planes(none, queries.tokenizer_path()).documents().count() == 0


@pytest.mark.parametrize("form", [token_planes.BIT, token_planes.BYTE])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 65_536])
def test_planes_go_round(form, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    data = token_planes.encode_chunk(ids, form)
    assert (token_planes.decode_chunk(data) == ids).all()
    if n > 8:
        with pytest.raises(Exception):
            token_planes.decode_chunk(data[:-3] + b"abc")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZÉß.,!' \n\t\x01\x1c0<|>क़İσ")), max_size=40), max_size=5))
def test_word_ids_equal_the_tokenizer(texts):
    w = _words()
    assert [np.frombuffer(x, "<u4").tolist() for x in w.encode(texts)] == [w.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def _words(held=[]):  # noqa: B006  one table for all examples
    if not held:
        held.append(WordIds(queries.tokenizer_path()))
    return held[0]


@given(st.binary(), st.binary())
def test_crc_of_two_parts(a, b):
    assert crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_audio(odd, none):
    rows = A.audio_features(A.store_media(odd).read()).collect()
    assert len(rows) == odd.count() and {r.payload_bytes for r in rows if r.doc_id in (0, 1)} == {576}
    import pyarrow as pa

    t = pa.ipc.open_stream(next(r for r in rows if r.doc_id == 4).tensors).read_all()
    assert t.column("log_mel").type.shape == [8, 20] and (np.diff(t.column("start_s")) > 0).all()
    assert A.audio_features(A.store_media(none).read()).count() == 0
    with pytest.raises(ValueError):
        A.from_wav(b"RIFF" + bytes(60))


def test_resampler_keeps_a_tone():
    s = A.AudioSetting()
    n = np.arange(3000)
    got = A.resample(np.sin(2 * np.pi * 500 * n / 8000).astype(np.float32), s.taps(), s)
    want = np.sin(2 * np.pi * 500 * np.arange(2000) / (8000 * 2 / 3))
    assert np.abs(got[100:1900] - want[100:1900]).max() < 1e-3


def plain_resample(x: np.ndarray, s: A.AudioSetting) -> np.ndarray:
    """Zeros put between samples, the whole filter, every ``down``-th sample taken."""
    wide = max(s.up, s.down)
    n = np.arange(-s.half_taps * wide, s.half_taps * wide + 1)
    h = np.sinc(n / wide) * np.hanning(len(n) + 2)[1:-1] * s.up / wide
    up = np.zeros(len(x) * s.up)
    up[:: s.up] = x
    return np.convolve(up, h)[s.half_taps * wide :][: len(up)][:: s.down]


def plain_log_mel(x: np.ndarray, s: A.AudioSetting) -> np.ndarray:
    """Frame by frame, with a plain Fourier sum and triangles drawn bin by bin."""
    frames = max(1, -(-max(0, len(x) - s.frame) // s.hop) + 1)
    top = s.rate * s.up / s.down / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, mel(top), s.mels + 2)]
    basis = np.exp(-2j * np.pi * np.outer(np.arange(s.frame), np.arange(s.frame // 2 + 1)) / s.frame)
    out = np.zeros((frames, s.mels))
    for i in range(frames):
        part = np.zeros(s.frame)
        cut = x[i * s.hop : i * s.hop + s.frame]
        part[: len(cut)] = cut
        power = np.abs((part * np.hanning(s.frame)) @ basis) ** 2
        for m in range(s.mels):
            a, b, c = edges[m : m + 3]
            weight = [max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) for f in np.arange(s.frame // 2 + 1) / (s.frame // 2) * top]
            out[i, m] = np.log(power @ np.asarray(weight) + 1e-3)
    return out


@pytest.mark.parametrize(("n", "block"), [(1, 4096), (50, 1), (576, 2), (5000, 7), (5000, 4096)])
def test_log_mel_equals_the_plain_version(n, block):
    """Whatever the blocks of frames, and for signals shorter than a frame."""
    s = A.AudioSetting(block=block)
    raw = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    x = (raw.astype(np.float64) - 128) / 128
    slow = plain_resample(x, s)
    assert np.abs(A.resample(raw, s.taps(), s) - slow).max() < 1e-4
    got = A.log_mel(raw, s, s.taps(), np.hanning(s.frame).astype(np.float32), s.filters())
    want = plain_log_mel(slow, s)
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-2


def test_features_are_read_back(spark, odd):
    """The digest of the query is that of the stored tensors and spans, which a plain version gives too."""
    import pyarrow as pa

    s = A.AudioSetting()
    rows = {(r.doc_id, r.payload_sha256): r for r in A.store_features(A.store_media(odd).read()).read().withColumn("feature", A.feature()).collect()}
    r = next(r for (d, _), r in rows.items() if d == 9)
    raw = np.frombuffer(odd.where("doc_id = 9").first().text.encode().ljust(576, b"\xff"), np.uint8)
    mel = plain_log_mel(plain_resample((raw.astype(np.float64) - 128) / 128, s), s)
    t = pa.ipc.open_stream(r.tensors).read_all()
    got = t.column("log_mel").combine_chunks().to_numpy_ndarray().reshape(-1, s.mels)
    assert np.abs(got[: len(mel)] - mel).max() < 1e-2 and r.n_frames == len(mel)
    second = s.hop / (s.rate * s.up / s.down)
    spans = [(a * second, b * second) for a, b in A.segments(got[: len(mel)].mean(axis=1), s.high, s.low)]
    assert [(x.start_s, x.end_s) for x in r.spans] == spans
    text = " ".join(f"{a:.3f}-{b:.3f}" for a, b in spans).encode()
    assert r.feature == f"{len(mel)}:{len(spans)}:{sum(b - a for a, b in spans):.3f}:{hashlib.md5(r.tensors + text).hexdigest()}"


def test_segments_by_hysteresis():
    e = np.array([0, 0, 5, 1, 1, 0, 0, 1, 0, 0, 0, 0.0])
    assert A.segments(e + np.linspace(-0.01, 0.01, 12), 300.0, 30.0) == [(2, 5)]


def test_co_training_without_labels_keeps_all(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    assert {(r.score, r.keep) for r in Q.score_documents(odd, labels).collect()} == {(0.5, True)}
    assert Q.keep_good(odd, labels).count() == odd.count() and Q.score_documents(none, labels).count() == 0


def plain_word_features(text: str) -> list[float]:
    """Word by word, with dictionaries; bins by the same hashes of single words and pairs."""
    w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode())
    import pyarrow as pa

    from papyra.llm.shared import text_buffer
    from papyra.llm.word_hashes import Words, run_hashes

    def hashed(k: int, i: int) -> int:
        h = Words(*text_buffer(pa.array([b" ".join(w[i : i + k]).decode()]))).hashes()
        return int(h[0] if k == 1 else run_hashes(h, k)[0])

    out = np.zeros(Q.REPEAT + 2 * Q.BINS)
    if w:
        out[0], out[2] = len(set(w)) / len(w), max(w.count(x) for x in w) / len(w)
        out[1] = len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) / max(1, len(w) - 2)
    for k, first in ((1, Q.REPEAT), (2, Q.REPEAT + Q.BINS)):
        for i in range(len(w) - k + 1):
            out[first + hashed(k, i) % Q.BINS] += 1 / (len(w) + Q.PRIOR)
    out[Q.REPEAT :] = np.sqrt(out[Q.REPEAT :])
    return out.tolist()


def test_word_features_equal_the_plain_version():
    import pyarrow as pa

    texts = ["", None, "one", "One one ONE two", "a b c a b c a b c", "x y", " \n", "é É tail", " ".join(f"w{i % 7}" for i in range(50))]
    got = Q.content_features(pa.array(texts))[:, Q.SHAPE :]
    assert np.abs(got - np.asarray([plain_word_features(t or "") for t in texts])).max() < 1e-6


def test_co_training_sees_words(spark):
    """Spam of the same letters, the same word lengths and the same metadata as prose: only its words and repeats tell."""
    rng, rows = random.Random(4), []
    prose, spam = ["stone", "river", "under", "light", "paper", "chair", "green", "small", "north", "early"], ["cheap", "pills", "order", "today", "extra"]
    for i in range(900):
        good = i % 3 > 0
        words = [rng.choice(prose) for _ in range(60)] if good else [rng.choice(spam) for _ in range(20)] + [rng.choice(prose) for _ in range(40)]
        rng.shuffle(words)
        text = " ".join(words)
        rows.append((i, text, "en", "web", len(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in Q.score_documents(docs, labels).collect()}
    assert np.mean([got[i].keep == (i % 3 > 0) for i in range(300, 900)]) > 0.99


def test_co_training_odd_labels(spark, odd):
    """Repeated and null ids with labels of both classes: every row is scored, equal rows alike."""
    more = spark.createDataFrame([(100 + i, "plain words here and there" if i % 2 else "### ||| $$$ %%%", "en", "s", 20) for i in range(60)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = odd.select(*more.columns).union(more).union(more)
    labels = more.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality").union(spark.createDataFrame([(None, 1), (3, 1), (3, 0), (9, None)], "doc_id bigint, quality int"))
    rows = Q.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and len({(r.doc_id, r.score) for r in rows if r.doc_id == 3}) == 1
    assert all(r.keep == (r.doc_id % 2 == 1) for r in rows if (r.doc_id or 0) >= 100)


def test_co_training_teaches_across_views(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        good = i % 3 > 0
        text = " ".join(rng.choice(["plain", "words", "here", "flow"]) + ("" if good else "###") for _ in range(40))
        rows.append((i, text, "en", "clean" if good else "dirty", len(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in Q.score_documents(docs, labels).collect()}
    assert all(got[i].keep == (i % 3 > 0) for i in range(600))
    assert np.mean([(got[i].meta_score > 0.5) == (i % 3 > 0) for i in range(600)]) > 0.99


def test_packing(odd, none):
    rows = B.pack_documents(odd, queries.tokenizer_path()).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1 and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert B.pack_documents(none, queries.tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_minimum_slack_fills_bins(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = B.minimum_slack(counts, 64)
    used = {n: 0 for n in counts}
    for bins, chosen in plan:
        assert sum(n * c for n, c in chosen.items()) <= 64
        for n, c in chosen.items():
            used[n] += bins * c
    assert used == counts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8), st.integers(0, 60))
def test_fullest_is_the_best_sum(counts, space):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    chosen = B.fullest(counts, space)
    assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= space)
    assert all(c <= counts[n] for n, c in chosen.items())


def fluid(sizes: dict[str, tuple[int, int]]):
    """The target of every source after t slots: all that still have blocks are served in proportion to their weights."""
    v, got, at, points = Fraction(0), dict.fromkeys(sizes, Fraction(0)), Fraction(0), []
    ends = sorted({Fraction(b, w) for b, w in sizes.values()})
    for end in ends:
        rate = sum(w for b, w in sizes.values() if Fraction(b, w) > v)
        points.append((at, v, rate))
        at, v = at + rate * (end - v), end

    def target(t: int) -> dict[str, Fraction]:
        start, v0, rate = [p for p in points if p[0] <= t][-1]
        now = v0 + (t - start) / rate
        return {s: min(w * now, Fraction(b)) for s, (b, w) in sizes.items()}

    return target


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 40), st.sampled_from([1, 1, 2, 3, 7])), min_size=3, max_size=9))
def test_pfair_stays_within_one_block(spark, sizes):
    """After any number of slots, to the very last, every source is less than one block off its target."""
    sizes = {f"s{i}": x for i, x in enumerate(sizes)}
    df = spark.createDataFrame([(i * 10 + k, s) for k, (s, (b, _)) in enumerate(sizes.items()) for i in range(b)], "doc_id bigint, source string")
    rows = sorted((r.slot, r.source, r.ordinal) for r in M.interleave(df, {s: w for s, (_, w) in sizes.items()}).collect())
    assert [s for s, _, _ in rows] == list(range(sum(b for b, _ in sizes.values())))
    target, had = fluid(sizes), dict.fromkeys(sizes, 0)
    for t, (_, s, ordinal) in enumerate(rows):
        assert ordinal == had[s]
        had[s] += 1
        assert all(abs(had[x] - y) < 1 for x, y in target(t + 1).items())


def test_pfair_with_the_weights_of_the_query(spark):
    """A case in which rounds that start anew at a source's last blocks are more than one block off while all still run."""
    for weights, blocks in (({"src0": 3, "src1": 5, "src2": 2, "src3": 7}, {"src0": 32, "src1": 53, "src2": 21, "src3": 71}), ({"a": 70, "b": 10}, {"a": 75, "b": 30})):
        df = spark.createDataFrame([(i, s) for s in blocks for i in range(blocks[s])], "doc_id bigint, source string")
        order = [r.source for r in M.interleave(df, weights).orderBy("slot").collect()]
        had, total = dict.fromkeys(blocks, 0), sum(weights.values())
        for t, s in enumerate(order):
            assert all(abs(had[x] - Fraction(t * weights[x], total)) < 1 for x in had)
            had[s] += 1
            if had[s] == blocks[s]:
                break


def test_pfair_with_many_sources(spark):
    """More sources than a round had slots before; all of one weight take turns."""
    df = spark.range(45_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 22_000).cast("string")).alias("source"))
    got = M.interleave(df, {"s1": 5}, 2)
    assert got.select("slot").distinct().count() == 45_000
    late = got.where("source <> 's1' and ordinal = 1").agg(F.min("slot")).first()[0]
    assert got.where("source <> 's1' and ordinal = 0").agg(F.max("slot")).first()[0] < late + 2


def test_pfair_over_ranges_of_ids(spark, monkeypatch):
    """Ranges, salts and runs change nothing; one far id doesn't matter."""
    df = spark.createDataFrame([(10**12 if i == 0 else i, f"s{i % 3}") for i in range(600)] + [(None, "s0")], "doc_id bigint, source string")
    want = sorted(map(tuple, M.interleave(df, {"s0": 3}, 2, 2).collect()), key=str)
    monkeypatch.setattr(M, "RANGE_ROWS", 50)
    monkeypatch.setattr(M, "BROADCAST_PLACES", 0)
    monkeypatch.setattr(M, "RUN", 3)
    assert sorted(map(tuple, M.interleave(df, {"s0": 3}, 2, 2).collect()), key=str) == want


def test_pfair_odd_rows(odd, none):
    rows = M.interleave(odd, {"src0": 2}, 1, 2)
    assert rows.count() == odd.count() and set(odd.columns) - {"slot"} <= set(rows.columns)
    assert rows.select("slot", "in_block").distinct().count() == odd.count()
    assert M.interleave(none, {}).count() == 0 and M.in_mixed_order(odd.drop("slot"), {}).count() == odd.count()
    with pytest.raises(ValueError):
        M.interleave(odd, {"src0": 0})


VECTORS = "vec_id bigint, embedding array<float>, v string, score string"


def test_topk_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    m = (rng.normal(size=(700, 12)) * rng.gamma(1, 1, (700, 1))).astype(np.float32)
    m[11], m[13] = m[12], m[12]  # ties
    df = spark.createDataFrame([(i, [float(x) for x in r], "", "") for i, r in enumerate(m)], VECTORS)
    v = np.floor(m.astype(np.float64) * 64).astype(int)
    want = []
    for q in range(0, 700, 20):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate(order)]
    got = N.top_inner_products(df, F.col("vec_id") % 20 == 0, candidate_block=100, query_block=10)
    assert sorted(map(tuple, got.collect())) == want


def test_topk_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, nan]), (2, None), (3, [1.0, inf]), (4, [3.0, None]), (5, [1.0]), (6, [2.0, 2.0]), (6, [2.0, 2.0]), (20, []), (None, [1.0, 1.0]), (7, [1e9, -1e9])]
    df = spark.createDataFrame([(i, v, "", "") for i, v in rows], VECTORS)
    got = sorted(map(tuple, N.top_inner_products(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 6, 64 * 128 + 128 * 128), (0, 2, 7, 64 * 64 * 10**9 - 128 * 64 * 10**9)]
    assert N.top_inner_products(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_scans_end_early(spark, monkeypatch):
    """Lengths that fall fast: the short vectors' blocks are never met, and the result is that of all pairs."""
    rng = np.random.default_rng(6)
    m = rng.normal(size=(1200, 8)) * np.where(np.arange(1200) < 150, 10.0, 0.05)[:, None]
    order = rng.permutation(1200)
    m = m[order].astype(np.float32)
    m[::20] = rng.normal(size=(60, 8)) * 3  # the queries
    df = spark.createDataFrame([(i, [float(x) for x in r], "", "") for i, r in enumerate(m)], VECTORS)
    v = np.floor(m.astype(np.float64) * 64).astype(int)
    want = {(q, k + 1, int(i), int((v @ v[q])[i])) for q in range(0, 1200, 20) for k, i in enumerate([i for i in np.lexsort((np.arange(1200), -(v @ v[q]))) if i != q][:5])}
    met = []
    meet = N._meet
    monkeypatch.setattr(N, "_meet", lambda c, q, first, k: met.append(first) or meet(c, q, first, k))
    got = N.top_inner_products(df, F.col("vec_id") % 20 == 0, k=5, candidate_block=50, query_block=16).collect()
    assert set(map(tuple, got)) == want and max(met) < 20


def test_topk_wide_scores(spark):
    """Exact beyond 2^53 and beyond 64 bits, where the nearest 64-bit number counts; ties go to the smaller id."""
    rows = [(0, [1e18, 1.0]), (1, [1e18, 1e18]), (2, [-1e18, 3.0]), (3, [1e9, 7.0]), (4, [1e9, 8.0]), (20, [3e8, 0.25])]
    df = spark.createDataFrame([(i, v, "", "") for i, v in rows], "vec_id bigint, embedding array<double>, v string, score string")
    most, edge = 2**63 - 1, lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
    scaled = {i: [max(-(2**63), min(most, int(np.floor(64 * x)))) for x in v] for i, v in rows}
    want = []
    for q in (0, 20):
        order = sorted((-edge(sum(a * b for a, b in zip(scaled[q], scaled[i]))), i) for i in scaled if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert sorted(map(tuple, N.top_inner_products(df, F.col("vec_id") % 20 == 0).collect())) == want


def test_urls(spark):
    urls = ["https://A.Example.com/en/7x?q#f", "http://example.net/de/81", "http://x.net/de/", "ftp://org/es/1", "no scheme free ref", None, "http://h?x", "http://a.org/casino/", "http://a.org/casinos", "http://a.org/free-ref/ref", "http://u:p@Com:80/en/"]
    rows = [U.split_url(u) for u in urls]
    assert rows[:2] == [("a.example.com", "/en/7x"), ("example.net", "/de/81")] and rows[5] == ("", "") and rows[6] == ("h", "")
    df = spark.createDataFrame([(i, u, "", "") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(df).collect()}
    assert got[0] == ("example.com/en/7", "allow") and got[1] == ("example.net/de/8", "block") and got[2] == ("net/de/", "allow") and got[3] == ("org/es/", "block")
    assert got[4] == (None, "block") and got[5] == (None, "allow") and got[7] == (None, "block") and got[8] == (None, "allow") and got[9] == (None, "block")
    assert U.filter_urls(df.limit(0)).count() == 0


def plain_repeats(docs: list[tuple[int, str]], window: int = 20) -> dict[int, tuple]:
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            seen.add(k)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_repeats_equal_the_plain_version(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)  # noqa: E731  few words: anchors repeat by chance
    passages = [[word() for _ in range(rng.randint(15, 60))] for _ in range(8)]
    docs = []
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(0, 6))]
        docs.append((d, " ".join(x for p in parts for x in p)))
    docs += [(60, "a a " * 100), (61, "a " * 19), (62, "a " * 20), (63, "")]
    df = spark.createDataFrame([(d, t, "s") for d, t in docs], "doc_id bigint, text string, others string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in seed_extend.remove_repeats(df).collect()}
    assert got == plain_repeats(docs)


def test_repeats_odd_rows(odd, none):
    rows = seed_extend.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and {r.n_words for r in rows if r.doc_id in (0, 1, 2)} == {0}
    by = {r.doc_id: r for r in rows}
    assert by[5].n_removed == 30_000 and by[5].text == "" and by[6].n_removed == 30_000 and by[6].text == "tail" and by[9].text == odd.where("doc_id = 9").first().text
    assert set(odd.columns) <= set(rows[0].asDict()) and seed_extend.remove_repeats(none).count() == 0


def plain_links(docs: list[tuple[int, str]], s: J.JoinSetting) -> dict[int, tuple[int, int]]:
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[d] = {tuple(w[i : i + s.words]) for i in range(max(1, len(w) - s.words + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and s.links(len(sets[a]), len(sets[b]), len(sets[a] & sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80), (1, 60)])
def test_links_equal_the_plain_version(spark, words, num):
    rng = random.Random(words)
    base = [[f"{b}x{rng.randint(0, 60)}" for _ in range(rng.choice([3, 12, 40, 150, 400]))] for b in range(12)]
    docs = []
    for d in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 12))):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 500)}"
        docs.append((d, " ".join(w).upper() if d % 7 == 0 else " ".join(w)))
    docs += [(260, ""), (261, "x"), (262, "X"), (263, "x y")]
    s = J.JoinSetting(words, num, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(docs, "doc_id bigint, text string"), s).collect()}
    assert got == plain_links(docs, s)


@pytest.mark.parametrize(("words", "num"), [(3, 90), (5, 80)])
def test_links_of_short_texts_at_the_threshold(spark, words, num):
    """Isolated pairs of 4 to 30 shingles that link with none to spare; their cells are few, and some are empty in both."""
    s, rng, docs = J.JoinSetting(words, num, 100), random.Random(num), []
    for a in range(4, 31):
        least = [(b, n) for b in range(a, 31) for n in range(1, a + 1) if s.links(a, b, n) and n < b and not s.links(a, b, n - 1)]
        for b, n in least * 6:
            k = len(docs)
            both = [f"t{k}x{i}" for i in range(n + words - 1)]
            docs += [(k, " ".join(both + [f"a{k}x{i}" for i in range(a - n)])), (k + 1, " ".join(both + [f"b{k}x{i}" for i in range(b - n)]))]
    rng.shuffle(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(docs, "doc_id bigint, text string"), s).collect()}
    assert len(docs) > 300 and got == plain_links(docs, s)


def test_links_of_short_texts_through_common_cells(spark):
    """Pairs that meet in costly tokens and empty cells only: near copies of one short text among its other near copies."""
    s, rng = J.JoinSetting(1, 80, 100), random.Random(8)
    docs = []
    for base in range(40):
        w = [f"b{base}x{i}" for i in range(4 + base % 27)]
        for _ in range(24):
            gone = rng.sample(range(len(w)), max(1, len(w) // 9))
            docs.append((len(docs), " ".join(f"n{len(docs)}x{i}" if i in gone else x for i, x in enumerate(w))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(docs, "doc_id bigint, text string"), s).collect()}
    assert got == plain_links(docs, s)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.sampled_from([(3, 90), (5, 80), (1, 60)]), st.integers(0, 10**6))
def test_prefixes_share_what_they_ask_for(n, setting, seed):
    """Linked sets share as many prefix shingles as the smaller l; frequent shingles come last and lengthen a prefix."""
    s, rng = J.JoinSetting(setting[0], setting[1], 100), np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n).astype(np.uint64)
    sets = []
    for _ in range(6):
        kept = base[rng.random(n) > 0.12 * rng.random()]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, rng.integers(0, 1 + n // 8)).astype(np.uint64)])))
    counts = J.Frequencies()
    counts.add(np.concatenate(sets + [base[: n // 2]] * 500))
    sizes = np.asarray([len(x) for x in sets])
    token, owner, need, often = J.prefix_tokens(np.concatenate(sets), sizes, s, counts)
    mine = {i: set(token[owner == i].tolist()) for i in range(6)}
    for i in range(6):
        assert (np.diff(often[owner == i]) >= 0).all() and len(mine[i]) == (sizes[i] - s.needed(sizes)[i] + need[owner == i][0] if sizes[i] else 0)
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if sizes[i] and sizes[j] and s.links(int(sizes[i]), int(sizes[j]), both):
                assert len(mine[i] & mine[j]) >= min(need[owner == i][0], need[owner == j][0])


def test_costly_prefixes_are_longer():
    s, values = J.JoinSetting(3, 90, 100), np.sort(np.random.default_rng(1).integers(0, 2**63, 200).astype(np.uint64))
    rare, hot = J.Frequencies(), J.Frequencies()
    for _ in range(1000):
        hot.add(values)
    short, long = (J.prefix_tokens(values, np.asarray([200]), s, f)[2][0] for f in (rare, hot))
    assert short == 10 and long > short


def test_links_odd_rows(odd, none):
    rows = J.linked(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r.component_id for r in rows}
    assert by[4] == by[5] == by[6] == 4 and by[7] == by[8] == 7 and by[0] == 0 and by[1] == 1 and by[None] is None
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 0, 1, 2, 3, 4, 7, 9}
    assert J.linked(none).count() == 0


def test_one_row_of_each_component(spark, odd):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = [(1, b), (3, a), (3, a), (3, b), (4, a + " end"), (5, "c"), (5, "c"), (6, None), (6, None), (6, ""), (None, "d"), (None, "d"), (7, "D")]
    rows = J.one_of_each(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(1, b), (3, a), (5, "c"), (6, None), (6, ""), (None, "d")], key=str)
    assert J.one_of_each(odd).count() == 8


CHATS = "conv_id bigint, turn bigint, role string, text string"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet=st.sampled_from(list("\\<|>\nab")), max_size=8), st.text(alphabet=st.sampled_from(list("\\<|>\nim_endé😀")), max_size=20)), min_size=1, max_size=6))
def test_chats_go_round(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], CHATS)
    chats = C.format_chats(df.withColumn("parts", C.text_parts(F.col("text"))))
    r = chats.select(C.read_turns(F.col("formatted")).alias("t")).first()
    assert [(t.role, t.text) for t in r.t] == turns


def test_chat_parts(spark):
    part = "struct<kind: string, text: string, ref: string, units: int>"
    df = spark.createDataFrame(
        [
            (1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", 2), ("document", None, "d.pdf", 3), ("text", "<|image:0|>", None, None)]),
            (1, 1, "assistant", [("audio", None, "s.wav", 4), ("text", None, None, None)]), (1, None, None, None), (None, 0, "assistant", []),
        ],
        f"conv_id bigint, turn bigint, role string, parts array<{part}>",
    )
    by = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert by[1].formatted == "<|im_start|><|im_sep|><|im_end|><|im_start|>user<|im_sep|>see <|image:0|><|document:1|><\\|image:0\\|><|im_end|><|im_start|>assistant<|im_sep|><|audio:2|><|im_end|>"
    assert [(a.kind, a.ref, a.tokens) for a in by[1].attachments] == [("image", "a.png", 512), ("document", "d.pdf", 1200), ("audio", "s.wav", 100)] and by[1].attachment_tokens == 1812
    assert "".join(by[1].segments) == by[1].formatted and by[1].loss.count(True) == 1 and by[None].formatted.startswith("<|im_start|>assistant")
    assert C.format_chats(df.limit(0)).count() == 0


PIECE = st.one_of(
    st.tuples(st.just("text"), st.text(alphabet=st.sampled_from(list("\\<|>\nab:0")), max_size=6)),
    st.tuples(st.just("text"), st.sampled_from(["<", "|", "|im_end|>", "<|im_start|>assistant", "<|im_sep|>x", "\\", "im_sep|>forged", "<|image:0|>", "0|>", "", None])),
    st.tuples(st.sampled_from(["image", "audio", "document", "im_start", "im_end|><|im_start|>assistant<|im_sep|>", "k:1|>", "\\", ""]), st.sampled_from(["a.png", None])),
)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|im_sep|>", "a\\"]), st.lists(PIECE, max_size=7)), min_size=1, max_size=4))
def test_parts_split_anywhere_go_round(spark, turns):
    """Whatever the parts hold and wherever texts are split: the same roles, texts and attachments come back."""
    part = lambda k, x: (k, x if k == "text" else None, None if k == "text" else x, None)
    df = spark.createDataFrame([(1, i, r, [part(*p) for p in parts]) for i, (r, parts) in enumerate(turns)], f"conv_id bigint, turn bigint, role string, parts array<{C.PART}>")
    got = C.format_chats(df).select(C.read_parts(F.col("formatted"), F.col("attachments")).alias("t"), C.read_turns(F.col("formatted")).alias("n")).first()
    want = []
    for role, parts in turns:
        seen = []
        for kind, x in parts:
            if kind != "text":
                seen.append((kind, None, x, {"image": 256, "audio": 25, "document": 400}.get(kind, 1)))
            elif x and seen and seen[-1][0] == "text":
                seen[-1] = ("text", seen[-1][1] + x, None, None)
            elif x:
                seen.append(("text", x, None, None))
        want.append((role, seen))
    assert [(t.role, [tuple(p) for p in t.parts]) for t in got.t] == want
    assert [t.role for t in got.n] == [r for r, _ in turns]


def test_chats_odd_rows(spark):
    """Repeated rows are turns of their own, columns named like ours do no harm, many units and units below 0 are counted."""
    part = lambda u: [("image", None, "a", u)]
    df = spark.createDataFrame([(1, 0, "user", part(2_000_000_000), "x", 1)] * 2 + [(2, 0, "user", part(-3), "y", 2), (2, 1, "user", None, "z", 3)], f"conv_id bigint, turn bigint, role string, parts array<{C.PART}>, formatted string, t int")
    by = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert by[1].attachment_tokens == 2 * 256 * 2_000_000_000 and by[1].formatted.count("<|im_start|>user") == 2 and by[2].attachment_tokens == 0
    long = "|<" * 300_000
    one = C.format_chats(spark.createDataFrame([(1, 0, "user", long)], CHATS).withColumn("parts", C.text_parts(F.col("text"))))
    assert one.select(C.read_parts(F.col("formatted"), F.col("attachments"))[0]["parts"][0]["text"]).first()[0] == long
