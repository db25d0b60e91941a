"""Phrase collocation mining over vertical positional inverted lists.

Texts are cut into chunks of about ``CHUNK_WORDS`` words, whole documents each; words have positions in their chunk, with
a gap between pieces, so that no phrase goes over a piece's end. A chunk holds, for each of its words, the list of
positions (the postings), and at level m for each phrase of m words the list of its starts. Lists get longer
phrases by merges of sorted positions: of the starts of frequent phrases those stay that are followed by the start of
another (first and last m words of m + 1 are frequent), and the word at ``start + m`` is taken from the postings. The
length of a list is the phrase's exact frequency in the chunk.

Frequencies of all chunks meet by phrase: a chunk's phrases are cut into ranges of their hashes, one row for each range of what they are
made of (the numbers of the phrase without its last word and of that word) and of their lengths; a task that gets a range from all chunks
adds up the lengths, numbers the frequent phrases and tells each chunk which of its phrases they are. One of the chunks is asked to define
each such phrase (its words and parts). Nothing
grows with a word's frequency: a chunk sends one number for each of its phrases. Ranges are as many as chunks, about.

Scores, dropped phrases and ranks are joins over the frequent phrases. A phrase of m + 1 words is known by its first and
last m words, so each level takes the frequencies of all cuts from the level below. Whether a longer candidate swallows
a phrase shows in those of one word more, since frequencies only fall on the way to the longer one.

Defined results: a null text is empty, a null lang is ``und``; repeated rows count as often as they occur; words of any
length are whole; an empty table gives an empty table; other columns are ignored. Words are known by 64-bit hashes,
phrases of a chunk too; between chunks phrases are known by exact numbers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.shared import Stored, join_with_hubs, plain, release, small_batches, text_buffer, text_slices
from papyra.llm.word_hashes import LOWER, STEP, Words, mix

CHUNK_WORDS = 1 << 20
#: Bytes of text for each range of keys, and the least number of ranges.
RANGE_BYTES, LEAST_RANGES = 4 << 20, 64
#: Rows of one language that one task ranks, about.
RANK_ROWS = 20_000
#: Of zstandard; what is packed here is written and shuffled, so it is worth the time.
PACK_LEVEL = 6

#: What ends a piece, and what ends a word inside of one.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = BREAK.copy()
BLANK[[0x20, 0x09]] = True


@dataclass(frozen=True)
class PhraseSetting:
    least: int = 100
    words: int = 5
    factor: int = 1000
    swallow: int = 100  # percent of a phrase's frequency that a longer one needs to swallow it
    top: int = 2000


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    head = np.array([len(planes), *map(len, planes)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=PACK_LEVEL).compress(head + b"".join(planes))


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw, out = zstandard.ZstdDecompressor().decompress(data), []
    sizes = np.frombuffer(raw, "<i8", len(kinds) + 1)
    at = sizes.nbytes
    for kind, size in zip(kinds, sizes[1:]):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, int(size), at).reshape(width, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += int(size)
    return out


def steps(a: np.ndarray) -> np.ndarray:
    """Differences to the value before (unsigned ones wrap); a cumulative sum gives the values again."""
    return np.diff(a, prepend=a.dtype.type(0))


def pair_steps(prefix: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in order: the steps of the first, and of the second from one pair to the next with the same first."""
    first, second = steps(prefix), steps(word)
    new = first != 0
    new[:1] = True
    return first, np.where(new, word, second)


def pairs_of(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs again."""
    new = first != 0
    new[:1] = True
    total, at = np.cumsum(second, dtype=second.dtype), np.flatnonzero(new)
    before = total[at] - second[at]
    return np.cumsum(first, dtype=first.dtype), total - np.repeat(before, np.diff(np.append(at, len(new))))


def extend(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of phrases with one word more."""
    return mix(keys * np.uint64(STEP) + words + np.uint64(1))


@dataclass
class Lists:
    """Sorted keys and, one list after another, the sorted starts of each."""

    keys: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray
    #: What the phrases of each list are made of: number of the phrase without its last word, and of that word. (A word: its hash and 0.)
    prefix: np.ndarray | None = None
    word: np.ndarray | None = None
    #: All starts in order and the number of the list of each, once known.
    placed: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def of(keys: np.ndarray, starts: np.ndarray) -> tuple[Lists, np.ndarray]:
        """Lists of occurrences given by ascending starts; and the order in which these were taken."""
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return Lists(keys[new], np.diff(np.append(new, len(keys))).astype(np.int32), starts[order]), order

    def by_place(self, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ascending starts and the number of the list of each, of the chosen lists or of all."""
        if self.placed is None:
            owner, order = np.repeat(np.arange(len(self.keys)), self.lengths), np.argsort(self.starts)
            self.placed = self.starts[order], owner[order]
        starts, owner = self.placed
        if chosen is None:
            return starts, owner
        keep = np.zeros(len(self.keys), bool)
        keep[chosen] = True
        kept = keep[owner]
        return starts[kept], owner[kept]

    def firsts(self) -> np.ndarray:
        return self.starts[np.cumsum(self.lengths) - self.lengths] if len(self.keys) else self.starts[:0]

    def pack(self) -> bytes:
        """Steps of the keys and of all starts, and for each start its list, the longest lists having the smallest numbers: that packs better than list by list."""
        starts, owner = self.by_place()
        by = np.argsort(-self.lengths, kind="stable")
        number = np.empty(len(by), np.int32)
        number[by] = np.arange(len(by), dtype=np.int32)
        return pack(steps(self.keys[by]), steps(starts.astype(np.int32)), number[owner])

    @staticmethod
    def unpack(data: bytes) -> Lists:
        keys, gaps, owner = unpack(data, np.uint64, np.int32, np.int32)
        keys = np.cumsum(keys, dtype=np.uint64)
        by = np.argsort(keys)
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        owner, starts = number[owner], np.cumsum(gaps, dtype=np.int32)
        lengths = np.bincount(owner, minlength=len(keys)).astype(np.int32)
        return Lists(keys[by], lengths, starts[np.argsort(owner, kind="stable")], placed=(starts, owner))


ROWS = pa.schema(
    [
        ("chunk", pa.int64()), ("span", pa.int64()), ("base", pa.int32()), ("keys", pa.binary()),  # phrases of a range of keys
        ("lists", pa.binary()), ("postings", pa.binary()), ("words", pa.binary()),  # state of a chunk
        ("key", pa.int64()), ("prefix", pa.int64()), ("suffix", pa.int64()), ("f", pa.int64()), ("lang", pa.string()), ("word", pa.string()),  # a phrase, or (without key) words of a language
    ]
)
SCHEMA = "chunk bigint, span bigint, base int, keys binary, lists binary, postings binary, words binary, key bigint, prefix bigint, suffix bigint, f bigint, lang string, word string"


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) if n else pa.array([], f.type) for f in ROWS], schema=ROWS)


def _ranges(lists: Lists, spans: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each range of keys begins, and the order of lists within: by prefix and word, which packs well."""
    edges = np.array([-(-(i << 32) // spans) for i in range(1, spans)], np.uint64) << np.uint64(32)
    at = np.concatenate([[0], np.searchsorted(lists.keys, edges), [len(lists.keys)]])
    return at, np.lexsort((lists.word, lists.prefix, np.repeat(np.arange(spans), np.diff(at))))


def _spans(chunk: int, lists: Lists, spans: int) -> pa.RecordBatch:
    """What a chunk's lists are made of and their lengths, a row for each range of keys with any."""
    at, order = _ranges(lists, spans)
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
    lengths = lists.lengths[order]
    pairs = [pair_steps(lists.prefix[order[a:b]], lists.word[order[a:b]]) for _, a, b in rows]
    return _batch(
        len(rows), chunk=pa.array([chunk] * len(rows), pa.int64()), span=pa.array([i for i, _, _ in rows], pa.int64()), base=pa.array([a for _, a, _ in rows], pa.int32()),
        keys=pa.array([pack(*pair, lengths[a:b]) for pair, (_, a, b) in zip(pairs, rows)], pa.binary()),
    )


class Chunk:
    """Words of texts until they are enough for a chunk."""

    def __init__(self) -> None:
        self.raw: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.langs: dict[str, int] = {}
        self.bytes = self.size = self.end = 0

    def add(self, texts: pa.Array, langs: list[str]) -> None:
        raw, offsets = text_buffer(texts)
        raw = LOWER[raw]
        words = Words(raw, offsets, BLANK)
        n = len(words.starts)
        if not n:
            return
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)[words.doc]
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs], np.uint64)
        broken = np.cumsum(BREAK[raw], dtype=np.int64)[words.starts]
        new = np.ones(n, bool)
        new[1:] = (broken[1:] != broken[:-1]) | (words.doc[1:] != words.doc[:-1])
        places = np.arange(n) + np.cumsum(new) + self.end
        self.parts.append((mix(words.hashes() + seeds[lang]), places.astype(np.int32), words.starts + self.bytes, words.ends + self.bytes, lang))
        self.raw.append(raw)
        self.bytes, self.size, self.end = self.bytes + len(raw), self.size + n, int(places[-1]) + 1

    def rows(self, chunk: int, spans: int) -> Iterator[pa.RecordBatch]:
        keys, places, starts, ends, lang = (np.concatenate(x) for x in zip(*self.parts))
        lists, order = Lists.of(keys, places)
        one = order[np.cumsum(lists.lengths) - lists.lengths]  # an occurrence of each word
        raw = np.concatenate(self.raw).tobytes()
        text = b" ".join(raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist()))
        names = json.dumps(list(self.langs)).encode()
        words = pack(np.frombuffer(text, np.uint8), lang[one], np.frombuffer(names, np.uint8))
        lists.prefix, lists.word = lists.keys, np.zeros(len(lists.keys), np.uint64)
        yield _spans(chunk, lists, spans)
        # the hashes are in the ranges now: what is told of this level goes by places in their order
        lists = Lists(np.arange(len(lists.keys), dtype=np.uint64), lists.lengths, lists.starts)
        yield _batch(1, chunk=pa.array([chunk]), lists=pa.array([lists.pack()]), words=pa.array([words]))
        total = np.bincount(lang, minlength=len(self.langs))
        yield _batch(len(total), lang=pa.array(list(self.langs), pa.string()), f=pa.array(total, pa.int64()))


def _words(spans: int):
    """Level 1: the chunks of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            for cut in text_slices(batch):
                chunk.add(cut.column("text"), cut.column("lang").to_pylist())
                if chunk.size >= CHUNK_WORDS:
                    yield from chunk.rows(number, spans)
                    number, chunk = number + 1, Chunk()
        if chunk.size:
            yield from chunk.rows(number, spans)

    return run


FOUND = pa.schema([("chunk", pa.int64()), ("span", pa.int64()), ("base", pa.int32()), ("found", pa.binary())])


def _told(found: pa.Table, m: int, spans: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, frequencies to define (or 0), and numbers of a chunk's frequent phrases."""
    parts = []
    for span, base, data in zip(*(found.column(c).to_pylist() for c in ("span", "base", "found"))):
        place, define, rank = unpack(data, np.int32, np.int64, np.int32)
        parts.append((np.cumsum(place) + base, define, ((np.cumsum(rank, dtype=np.int64) * spans + span) * 8 + m).astype(np.uint64)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _frequent(least: int):
    """Of a range of keys from all chunks: numbers for the frequent phrases, told to each chunk that has them, and the frequency of those that it is to define.

    Numbers are unique over all ranges and levels and small, so that longer phrases pack well.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk").combine_chunks()
        parts = [unpack(x, np.uint64, np.uint64, np.int32) for x in t.column("keys").to_pylist()]
        parts = [(*pairs_of(first, second), count) for first, second, count in parts]
        row = np.repeat(np.arange(t.num_rows), [len(x[0]) for x in parts])
        place = np.concatenate([np.arange(len(x[0])) for x in parts])
        prefix, word, count = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((np.arange(len(row)), word, prefix))
        a, b = prefix[order], word[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        total = np.add.reduceat(count[order].astype(np.int64), first)
        often = total >= least
        rank = np.cumsum(often) - 1
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
        define, own, hit = np.zeros(len(row), np.int64), np.zeros(len(row), np.int32), np.zeros(len(row), bool)
        define[order[first[often]]] = total[often]
        own[order], hit[order] = rank[group].astype(np.int32), often[group]
        row, place, define, own = row[hit], place[hit].astype(np.int32), define[hit], own[hit]
        at = np.searchsorted(row, np.arange(t.num_rows + 1))
        some = [i for i in range(t.num_rows) if at[i + 1] > at[i]]
        base = np.asarray(t.column("base"))
        # places and ranks of a chunk both ascend: their steps are small
        packed = [pack(steps(place[at[i] : at[i + 1]]), define[at[i] : at[i + 1]], steps(own[at[i] : at[i + 1]])) for i in some]
        chosen = pa.array(some, pa.int64())
        return pa.table([*(t.column(c).take(chosen) for c in ("chunk", "span", "base")), pa.array(packed, pa.binary())], schema=FOUND)

    return run


def _merge(sorted_places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of the wanted places is among the sorted ones."""
    return np.searchsorted(sorted_places, wanted)


def _longer(lists: Lists, m: int, places: np.ndarray, words: np.ndarray) -> Lists:
    """From lists of frequent phrases of m words those of one word more."""
    starts, owner = lists.by_place()
    go = np.flatnonzero(np.append(starts[1:] == starts[:-1] + 1, False)) if len(starts) else np.zeros(0, np.int64)  # a frequent phrase starts at the next word too
    begin, prefix = starts[go], lists.keys[owner[go]]
    word = words[_merge(places, begin + m)]
    longer, order = Lists.of(extend(prefix, word), begin)
    one = order[np.cumsum(longer.lengths) - longer.lengths]
    longer.prefix, longer.word = prefix[one], word[one]
    return longer


def _level(m: int, most: int, spans: int):
    """From level m to m + 1: the phrases that this chunk defines, and what its phrases with one word more are made of.

    A chunk keeps the lists of frequent phrases only, by their numbers: those of level m are made again from the frequent ones below. At level 2
    these are the postings themselves.
    """

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if state.num_rows and found.num_rows:
            s = state.slice(0, 1).to_pylist()[0]
            known, define, number = _told(found, m, spans)
            if m == 1:
                lists = below = Lists.unpack(s["lists"])
                lists.prefix, lists.word = lists.keys, np.zeros(len(lists.keys), np.uint64)
            else:
                postings = Lists.unpack(s["postings"])
                places, at = postings.by_place()
                words = postings.keys[at]
                below = Lists.unpack(s["lists"]) if s["lists"] else postings
                lists = _longer(below, m - 1, places, words)
            known = _ranges(lists, spans)[1][known]
            out.append(_definitions(m, s, lists, below, known[define > 0], define[define > 0], number[define > 0]))
            if m < most:
                numbers = np.zeros(len(lists.keys), np.uint64)
                numbers[known] = number
                starts, owner = lists.by_place(known)
                often = Lists.of(numbers[owner], starts)[0]
                if m == 1:
                    places, words = starts, numbers[owner]
                longer = _longer(often, m, places, words)
                if len(longer.keys):
                    used, near = np.zeros(int(places[-1]) + 2, bool), np.zeros(int(places[-1]) + 2, bool)
                    begin = longer.starts
                    near[begin] = near[begin + 1] = True
                    used[begin + m] = True  # all words that longer phrases may end with
                    if m == 1:
                        used |= near
                    rest = Lists.of(words[used[places]], places[used[places]])[0]
                    kept = Lists.of(numbers[owner[near[starts]]], starts[near[starts]])[0]
                    out.append(_spans(s["chunk"], longer, spans))
                    out.append(_batch(1, chunk=pa.array([s["chunk"]]), lists=pa.array([kept.pack() if m > 1 else b""]), postings=pa.array([rest.pack()])))
        return pa.Table.from_batches(out, schema=ROWS)

    return run


def _definitions(m: int, s: dict, lists: Lists, below: Lists, own: np.ndarray, f: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    columns = {"key": pa.array(number.view(np.int64)), "f": pa.array(f)}
    if m == 1:
        text, lang, names = unpack(s["words"], np.uint8, np.int32, np.uint8)
        text, names = text.tobytes().split(b" "), json.loads(names.tobytes())
        columns |= {"word": pa.array([text[i].decode() for i in own], pa.string()), "lang": pa.array([names[lang[i]] for i in own], pa.string())}
    else:
        starts, owner = below.by_place()
        suffix = below.keys[owner[_merge(starts, lists.firsts()[own] + 1)]]
        columns |= {"prefix": pa.array(lists.prefix[own].view(np.int64)), "suffix": pa.array(suffix.view(np.int64))}
    return _batch(len(own), **columns)


def frequent_phrases(docs: DataFrame, s: PhraseSetting = PhraseSetting()) -> tuple[Stored, list[Stored]]:
    """(lang, f): words of each language; and by level the phrases of at least ``least`` occurrences: key, f and (level 1) lang and word or (above) prefix and suffix."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = plain(docs, ("text", "lang")).select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spans = max(LEAST_RANGES, int(size) // RANGE_BYTES)
    few = {"parquet.page.size.row.check.min": "4", "parquet.block.size.row.check.min": "4"}  # rows of a chunk are large
    rows, levels, totals = Stored(texts.mapInArrow(_words(spans), SCHEMA), "phrases-1", **few), [], None
    for m in range(1, s.words + 1):
        if m == 1:
            totals = Stored(rows.read().where("key is null and lang is not null").groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
        spread = rows.read().where("span is not null").select("span", "chunk", "base", "keys")
        found = Stored(spread.groupBy("span").applyInArrow(_frequent(s.least), "chunk bigint, span bigint, base int, found binary"), f"frequent-{m}")
        del spread
        release(spark)
        state = rows.read().where("lists is not null").select("chunk", "lists", "postings", "words")
        after = Stored(state.groupBy("chunk").cogroup(found.read().groupBy("chunk")).applyInArrow(_level(m, s.words, spans), SCHEMA), f"phrases-{m + 1}", **few)
        del state
        release(spark, rows, found)
        levels.append(Stored(after.read().where("key is not null").select("key", "f", "lang", "word", "prefix", "suffix"), f"level-{m}"))
        rows = after
    rows.drop()
    return totals, levels


def _parts(level: DataFrame, below: DataFrame) -> DataFrame:
    """Phrases with what the phrases of their first and last words, one fewer, are and have."""
    for part, taken in (("prefix", ("lang", "text", "lefts")), ("suffix", ("last", "rights"))):
        often = level.groupBy(F.col(part).alias("key")).agg(F.count("*").alias("n_rows"))
        known = often.join(below, "key").select(F.col("key").alias(part), "n_rows", F.col("f").alias(f"f_{part}"), *taken)
        level = join_with_hubs(level, known, part, "n_rows")
    return level.select(
        "key", "f", "prefix", "suffix", "lang", F.concat_ws(" ", "text", "last").alias("text"), "last",
        F.array_append("lefts", F.col("f_prefix")).alias("lefts"), F.array_prepend("rights", F.col("f_suffix")).alias("rights"),
    )


def _first_ranks(rows: DataFrame, s: PhraseSetting) -> DataFrame:
    """The first ``top`` rows of each language: best rows of ever fewer shares of it, so that no task ranks all."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    room = max(RANK_ROWS, 10 * s.top)
    shares = rows.count() // room
    while shares > 1:
        w = Window.partitionBy("lang", "share").orderBy(*order)
        rows = rows.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.top).drop("share", "rank")
        shares = shares * s.top // room
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= s.top)


def collocations(docs: DataFrame, s: PhraseSetting = PhraseSetting()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    spark = docs.sparkSession
    totals, found = frequent_phrases(docs, s)
    none = F.array().cast("array<bigint>")
    below = found[0].read().select("key", "f", "lang", F.col("word").alias("text"), F.col("word").alias("last"), none.alias("lefts"), none.alias("rights"))
    levels = []
    for level in found[1:]:
        levels.append(Stored(_parts(level.read().select("key", "f", "prefix", "suffix"), below), "phrases"))
        below = levels[-1].read().drop("prefix", "suffix")
    candidates = levels[0].read()
    for level in levels[1:]:
        candidates = candidates.union(level.read())
    enough = lambda part, f: F.when(F.col("f").cast("decimal(20,0)") * 100 >= f.cast("decimal(20,0)") * s.swallow, F.col(part))
    swallowed = candidates.select(F.explode(F.array(enough("prefix", F.element_at("lefts", -1)), enough("suffix", F.element_at("rights", 1)))).alias("key")).where("key is not null").distinct()
    kept = candidates.join(swallowed, "key", "left_anti").join(totals.read(), "lang")
    # decimals: products may pass 64 bits
    cuts = F.expr(
        f"transform(lefts, (l, i) -> struct(({s.factor}BD * cast(f as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(rights[i] as decimal(18,0))) as score, i, l, rights[i] as r))"
    )
    best = kept.select("lang", F.col("text").alias("phrase"), F.col("f").alias("a"), "n", F.array_min(cuts).alias("cut")).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    scored = Stored(best, "scored")
    release(spark, *found, *levels)
    return _first_ranks(scored.read(), s).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(s: PhraseSetting = PhraseSetting()) -> str:
    """All phrases of all pieces counted, all cuts, all longer candidates."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: words[i:i + m - 1])) AS ws FROM w, range(1, {s.words + 1}) t(m) WHERE len(words) >= m),
f AS MATERIALIZED (SELECT lang, m, ws, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= {s.least}),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT * FROM f WHERE m > 1),
u AS (SELECT lang, m, ws, f, unnest(range(1, m)) AS k FROM c),
s AS (SELECT u.lang, u.ws, u.f AS a, l.f AS l, r.f AS r, n, k, CAST({s.factor}::HUGEINT * u.f * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.ws = u.ws[:u.k] JOIN f r ON r.lang = u.lang AND r.ws = u.ws[u.k + 1:] JOIN n ON n.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
i AS (SELECT lang, f, unnest(list_transform(range(1, m - j + 2), lambda x: ws[x:x + j - 1])) AS ws FROM c, range(2, {s.words}) t(j) WHERE j < m),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.ws = b.ws AND 100 * i.f >= {s.swallow} * b.a)),
x AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, n, score FROM o)
SELECT lang, CAST(rank AS INT) AS rank, phrase, a, l, r, n, score FROM x WHERE rank <= {s.top}"""
