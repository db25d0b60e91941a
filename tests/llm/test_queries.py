"""Queries against DuckDB where SQL can say them, against plain versions where it can't."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from papyra.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def ids(duck):
    from tokenizers import Tokenizer

    rows = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    found = Tokenizer.from_file(queries.tokenizer_path()).encode_batch([t for _, t in rows], add_special_tokens=False)
    return {d: np.asarray([*f.ids, 1], "<u4") for (d, _), f in zip(rows, found)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_op1_reads_back_every_id(spark, ids):
    want, start = {}, 0
    for d, x in ids.items():
        want[d] = (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_planes(spark, SF).collect()} == want


def test_op2_payloads(spark, duck):
    want = {}
    for d, t in duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        raw = t.encode()
        p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want[d] = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    rows = queries.op2_audio_features(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
    same = defaultdict(set)
    for r in rows:
        same[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())


def test_op3_held_out_accuracy(spark):
    """A quarter of the labels is kept from training and used to judge."""
    from papyra.llm import co_training

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id: r.keep for r in co_training.score_documents(docs, labels.where("doc_id % 4 <> 0")).collect()}
    unseen = [(kept[r.doc_id], r.quality == 1) for r in labels.where("doc_id % 4 = 0").collect()]
    assert len(unseen) > 50 and np.mean([k for k, q in unseen if q]) >= 0.98
    assert np.mean([k == q for k, q in unseen]) > 0.95


def test_op4_packs_all_in_the_fewest(spark, ids):
    rows = queries.op4_bin_slack(spark, SF).collect()
    want = {(d, i): (a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes())) for d, x in ids.items() for i, a in enumerate(range(0, len(x), 4096))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_pipeline_runs_and_keeps_clean_documents(spark, duck):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality(spark, docs, SF)
    assert first.columns == docs.columns
    bad = {d for (d,) in duck.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()} - {r.doc_id for r in first.collect()}
    assert len(bad) <= 1
    second = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert second.select("text").distinct().count() == second.count()
    third = corpus_pipeline.repeated_passages(spark, docs, SF)
    assert third.count() == docs.count() and third.columns == docs.columns
    fourth = corpus_pipeline.mixed(spark, docs, SF)
    assert sorted(map(tuple, fourth.collect())) == sorted(map(tuple, docs.collect()))
    assert corpus_pipeline.run(spark, SF).count() > 0
