"""Substring dedup by seed and extend: join documents on winnowed anchors, extend both ways, keep maximal repeats.

A window is ``window`` consecutive words. Of its word 8-grams the one with the smallest hash is its anchor, so equal
windows have equal anchors at equal places, and a document needs only one anchor row for a run of windows.

1. Anchors are counted over all documents; those met once are gone.
2. A run of windows around an anchor that repeats carries the hashes of its windows, that is the extension to both
   sides as far as the anchor reaches. It is compared with the first occurrence of the anchor in the corpus: windows
   found there are repeats. Neighbouring runs join to maximal repeats.
3. Windows that differ from the first occurrence's are grouped by their own hash; all but the first are repeats too.

So a word is removed if and only if a window over it starts earlier in the corpus (smaller doc_id, or the same document
before). Groups meet by partial aggregates and joins on stored tables, never as all pairs, and a hot anchor is a join key
that Spark can split. Tables of each step go to the shared folder; shuffle files of a finished step are released.

Hashes: a window is known by its own and its anchor's 64 bits. Defined results: a null text has no words; texts with
fewer words than a window stay whole; rows with equal id and text are one document and stay or go alike; rows with equal
id and other text are ordered by a hash of the text; a null id comes first; an empty table gives an empty table; other
columns are ignored by ``repeats`` and passed through by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.shared import Stored, ordered_key, plain, release, small_batches, text_buffer, text_slices
from papyra.llm.word_hashes import Words, run_hashes, sliding_argmin

WINDOW = 20
ANCHOR = 8

def version(text: Column) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _runs(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: the anchor's hash, its word, the first window, the number of windows."""
    h = words.hashes()
    n = len(h) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    grams = run_hashes(h, anchor)
    place = sliding_argmin(grams, window - anchor + 1)[:n]
    starts = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    place = place[starts]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(starts) else starts
    return grams[place[new]], place[new], starts[new], np.diff(np.append(new, len(starts)))


def _anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in text_slices(batch):
                words = Words(*text_buffer(cut.column("text")))
                a, at, first, n = _runs(words, window, anchor)
                doc = words.doc[at]
                local = at - words.first[doc]
                packed = local << 8 | (at - first) << 4 | n  # a place: the anchor's first word, words back to the first window, windows
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), *(cut.column(c).take(pa.array(doc)) for c in ("d", "v")), pa.array(packed)], names=["a", "d", "v", "w"])

    return run


def _windows(window: int, anchor: int):
    """Rows with the hashes of the windows of every repeated run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in text_slices(batch):
                words = Words(*text_buffer(cut.column("text")))
                h = words.hashes()
                grams, wide = run_hashes(h, anchor), run_hashes(h, window)
                lists = cut.column("w")
                w, doc = np.asarray(lists.flatten()), np.repeat(np.arange(cut.num_rows), np.asarray(lists.value_lengths()))
                at = words.first[doc] + (w >> 8)
                n = w & 15
                begin = np.repeat(at - (w >> 4 & 15) - (np.cumsum(n) - n), n) + np.arange(n.sum())
                hashes = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), wide[begin].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), *(cut.column(c).take(pa.array(doc)) for c in ("d", "v")), pa.array(w), hashes], names=["a", "d", "v", "w", "hs"])

    return run


def _identified(docs: DataFrame, *more: str) -> DataFrame:
    return plain(docs, ("doc_id", "text", *more)).withColumn("d", ordered_key("doc_id")).withColumn("v", version(F.col("text")))


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> Stored:
    """(d, v, cuts): for every document with repeated windows, the first word and a bit mask of each group of windows."""
    if not 0 <= window - anchor <= 13:
        raise ValueError("a run of windows is packed into 4 bits: window - anchor must be 0 to 13")
    spark = docs.sparkSession
    small_batches(spark)
    texts = _identified(docs).select("d", "v", "text")
    anchors = texts.where(F.length("text") >= 2 * window - 1).mapInArrow(_anchors(window, anchor), "a bigint, d bigint, v bigint, w bigint")
    twice = Stored(anchors.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "anchors")
    release(spark)
    found = anchors.join(twice.read(), "a").groupBy("d", "v").agg(F.array_sort(F.collect_set("w")).alias("w"))
    runs = Stored(found, "runs")
    release(spark, twice)
    occurrences = Stored(texts.join(runs.read(), ["d", "v"]).select("text", "d", "v", "w").mapInArrow(_windows(window, anchor), "a bigint, d bigint, v bigint, w bigint, hs array<bigint>"), "windows")
    release(spark, runs)

    o = occurrences.read()
    firsts = Stored(o.groupBy("a").agg(F.min(F.struct("d", "v", "w", "hs")).alias("f")).select("a", F.col("f.d").alias("fd"), F.col("f.v").alias("fv"), F.col("f.w").alias("fw"), F.col("f.hs").alias("fhs")), "firsts")
    release(spark)
    back, fback = (F.shiftright(F.col(c), 4).bitwiseAND(F.lit(15)).cast("int") for c in ("w", "fw"))
    same = F.transform("hs", lambda h, i: F.coalesce(h == F.get(F.col("fhs"), i - F.col("back") + F.col("fback")), F.lit(False)))
    met = o.join(firsts.read(), "a").where("d <> fd or v <> fv or w <> fw").withColumn("back", back).withColumn("fback", fback).withColumn("same", same)
    at = (F.shiftright("w", 8) - F.col("back")).alias("at")
    mask = F.aggregate(F.transform("same", lambda s, i: F.when(s, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda x, y: x + y)
    rest = F.filter(F.transform("hs", lambda h, i: F.when(~F.col("same")[i], F.struct(h.alias("h"), i.alias("i")))), lambda x: x.isNotNull())
    compared = Stored(met.select("a", "d", "v", at, mask.alias("mask"), rest.alias("rest")), "compared")
    release(spark, occurrences, firsts)

    c = compared.read()
    extended = c.where("mask <> 0").select("d", "v", "at", "mask")
    lone = c.where(F.size("rest") > 0).select("a", "d", "v", "at", F.explode("rest").alias("r")).select("a", F.col("r.h").alias("h"), "d", "v", (F.col("at") + F.col("r.i")).alias("at"))
    early = Stored(lone.groupBy("a", "h").agg(F.count("*").alias("n"), F.min(F.struct("d", "v", "at")).alias("f")).where("n > 1").select("a", "h", F.col("f.d").alias("fd"), F.col("f.v").alias("fv"), F.col("f.at").alias("fat")), "early")
    later = lone.join(early.read(), ["a", "h"]).where("d <> fd or v <> fv or at <> fat").select("d", "v", "at", F.lit(1).alias("mask"))
    cuts = Stored(extended.union(later).groupBy("d", "v").agg(F.collect_set(F.struct("at", "mask")).alias("cuts")), "cuts")
    release(spark, compared, early)
    return cuts


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in text_slices(batch):
                raw, offsets = text_buffer(cut.column("text"))
                words, rows = Words(raw, offsets), []
                cuts, data = cut.column("cuts"), raw.tobytes()
                for i, doc_id in enumerate(cut.column("doc_id").to_pylist()):
                    a, n = int(words.first[i]), int(words.count[i])
                    text, removed = data[offsets[i] : offsets[i + 1]], 0
                    kept = text.split()
                    shown = text
                    if cuts[i].is_valid:
                        edge = np.zeros(n + 1, np.int64)
                        runs = cuts.slice(i, 1).flatten()
                        at, mask = np.asarray(runs.field("at")), np.asarray(runs.field("mask"))
                        for bit in range(16):
                            begin = at[mask >> bit & 1 == 1] + bit
                            np.add.at(edge, begin, 1)
                            np.add.at(edge, begin + window, -1)
                        gone = np.cumsum(edge[:n]) > 0
                        removed = int(gone.sum())
                        kept = [w for w, g in zip(kept, gone.tolist()) if not g]
                        begins = np.append(words.starts[a : a + n], offsets[i + 1]) - offsets[i]
                        turns = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
                        shown = b"".join(text[begins[x] : begins[y]] for x, y in zip(turns[::2], turns[1::2]))
                    rows.append((doc_id, n, removed, hashlib.sha256(b" ".join(kept)).hexdigest(), shown.decode()))
                columns = zip(list(zip(*rows)), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))
                out = [pa.array(c, t) for c, t in columns]
                yield pa.RecordBatch.from_arrays([*out, cut.column("others")], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text", "others"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The columns of ``docs`` with ``text`` cut (untouched where nothing repeats), then n_words, n_removed, kept_sha256.

    A cut text keeps its own white space between kept words; the digest is over the kept words joined by one space.
    """
    ours = ("n_words", "n_removed", "kept_sha256")
    others = [c for c in docs.columns if c not in ("doc_id", "text", *ours)]
    cuts = repeats(docs, window, anchor)
    rows = _identified(docs, *others).select("d", "v", "doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("others"))
    joined = rows.join(cuts.read(), ["d", "v"], "left").select("doc_id", "text", "cuts", "others")
    schema = joined.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_sha256"), "text", "others").schema
    out = joined.mapInArrow(_kept(window), schema)
    back = [F.col(f"`{c}`") if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns if c not in ours]
    return out.select(*back, *ours)
