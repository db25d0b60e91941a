"""Chunks of documents (IR-21/22, WN-14, AG-07)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as T


def token_windows(docs: DataFrame, size: int = 1000, overlap: int = 100, least: int = 50, id_col: str = "doc_id", text: str = "text", kind: str = "token_based") -> DataFrame:
    """Windows of ``size`` tokens between white space, each starting size - overlap after the last; short ones but the only one go."""
    step = size - overlap
    rows = docs.select(id_col, F.filter(F.split(F.coalesce(text, F.lit("")), T.GAP), lambda t: t != "").alias("t")).where(F.size("t") > 0)
    last = F.greatest(F.ceil((F.size("t") - overlap) / step), F.lit(1)) - 1
    rows = rows.select(id_col, F.size("t").alias("_n"), F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.slice("t", (i * step + 1).cast("int"), F.lit(size)))).alias("chunk_index", "w"))
    rows = rows.withColumn("token_count", F.size("w")).where((F.col("token_count") >= least) | (F.col("_n") < least))
    return rows.select(id_col, "chunk_index", "token_count", F.array_join("w", " ").alias("content"), F.lit(kind).alias("chunk_type"), F.concat_ws("_", id_col, F.lit(kind), "chunk_index").alias("chunk_id"))


def section_chunks(sections: DataFrame, id_col: str, size: int = 1000, overlap: int = 100, least: int = 50) -> DataFrame:
    """Windows inside each section; ids carry the section's slug."""
    keyed = sections.select(F.to_json(F.struct(id_col, "section", "title")).alias("_k"), "content")
    parts = token_windows(keyed, size, overlap, least, "_k", "content", "section_aware")
    key = F.from_json("_k", f"{id_col} string, section bigint, title string")
    return parts.select(key.alias("k"), "chunk_index", "token_count", "content", "chunk_type").select(
        F.col(f"k.{id_col}").alias(id_col), "k.section", "k.title", "chunk_index", "token_count", "content", "chunk_type", F.concat_ws("_", f"k.{id_col}", T.slug(F.col("k.title")), "chunk_index").alias("chunk_id")
    )


def pack_sentences(docs: DataFrame, most: int = 1000, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """IR-22: paragraphs, else lines, else sentences, else words joined greedily up to ``most`` characters.

    A fold over a text's separators; written as an Arrow function because a growing array in an expression costs its square.
    """
    def pieces(s: str, separators: tuple[str, ...]) -> Iterator[str]:
        if len(s) <= most or not separators:
            yield from (s[i : i + most] for i in range(0, len(s), most))
            return
        held = ""
        for part in s.split(separators[0]):
            joined = f"{held}{separators[0]}{part}" if held else part
            if len(joined) <= most:
                held = joined
                continue
            if held:
                yield held
            held = ""
            if len(part) <= most:
                held = part
            else:
                yield from pieces(part, separators[1:])
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in zip(b.column(0), b.column(1).to_pylist()):
                found = [p for p in pieces(s or "", ("\n\n", "\n", ". ", " ")) if p.strip()]
                if found:
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * n, b.schema.field(0).type), pa.array(range(n), pa.int32()), pa.array(found)], names=[id_col, "chunk_index", "content"])

    rows = docs.select(id_col, text)
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, chunk_index int, content string")


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """AG-07."""
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.avg("token_count").alias("avg_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"))


Encoder = Callable[[Sequence[str]], np.ndarray]


def hashed_vectors(sentences: Sequence[str], dims: int = 64) -> np.ndarray:
    """A row for each sentence: counts of its words at hashed places with hashed signs, of length one or zero. Stands in for a sentence model."""
    out = np.zeros((len(sentences), dims))
    for i, s in enumerate(sentences):
        for w in re.findall(r"\w+", s.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dims] += 1.0 if h >> 16 & 1 else -1.0
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


#: Sections whose sentences and vectors are held at a time.
SECTIONS = 64
#: What a chunk below the least size costs; far above any similarity.
SHORT = 1000.0


def best_boundaries(tokens: Sequence[int], alike: Sequence[float], size: int, least: int) -> list[int]:
    """First sentence of each chunk of the cheapest cut; ``alike[i]`` is the similarity of sentences i and i + 1.

    A cut costs the similarity that it goes through, plus one, so that it is taken only where needed; a chunk of more than one sentence has ``size`` tokens
    at most, and one below ``least`` costs SHORT. Dynamic programming over the sentences, each looking back as far as ``size`` tokens reach. Of equal cuts the one
    with the longest last chunk stands.
    """
    n, ends = len(tokens), np.append(0, np.cumsum(tokens))
    cost, back = [0.0] + [np.inf] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        i = j - 1
        while i >= 0 and (i == j - 1 or ends[j] - ends[i] <= size):
            here = cost[i] + (1 + alike[i - 1] if i else 0.0) + (SHORT if ends[j] - ends[i] < least else 0.0)
            if here <= cost[j] + 1e-12:
                cost[j], back[j] = here, i
            i -= 1
    firsts, j = [], n
    while j:
        j = back[j]
        firsts.append(j)
    return firsts[::-1]


def semantic_chunks(sections: DataFrame, id_col: str, size: int = 1000, least: int = 50, encode: Encoder = hashed_vectors, hybrid: bool = False, overlap: int = 100) -> DataFrame:
    """IR-21: rows (id, section, title, content) cut between sentences that are least alike; no chunk goes over a section.

    ``hybrid`` keeps a section of ``size`` tokens at most whole, and cuts a single sentence of more tokens into windows with ``overlap``. ``encode`` turns
    a list of sentences into vectors, one call for SECTIONS sections. Chunks of fewer than ``least`` tokens go, unless a section has no other. A null or
    blank content gives no chunk. ``chunk_id`` is the id, the title's slug and the number in the section.
    """
    kind = "hybrid" if hybrid else "semantic"

    def pieces(text: str, parts: list[str], vectors: np.ndarray) -> list[str]:
        tokens = [len(p.split()) for p in parts]
        if hybrid and sum(tokens) <= size:
            return [text.strip()]
        alike = (vectors[:-1] * vectors[1:]).sum(1) if len(parts) > 1 else []
        firsts = best_boundaries(tokens, alike, size, least)
        found = []
        for a, b in zip(firsts, [*firsts[1:], len(parts)]):
            words = " ".join(parts[a:b]).split()
            if hybrid and len(words) > size:
                found += [" ".join(words[i : i + size]) for i in range(0, max(1, len(words) - overlap), size - overlap)]
            else:
                found.append(" ".join(parts[a:b]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, SECTIONS) for whole in batches for at in range(0, whole.num_rows, SECTIONS)):
            texts = [t or "" for t in b.column("content").to_pylist()]
            parts = [[p for p in re.split(r"(?<=[.!?])[ \t\r\n]+|\n+", t) if p.strip()] for t in texts]
            vectors, at = encode([p for x in parts for p in x]), 0
            rows, numbers, sizes, out = [], [], [], []
            for i, (t, x) in enumerate(zip(texts, parts)):
                found = pieces(t, x, vectors[at : at + len(x)]) if x else []
                at += len(x)
                counts = [len(c.split()) for c in found]
                keep = [k for k, n in enumerate(counts) if n >= least] or list(range(len(found)))[:1]
                for number, k in enumerate(keep):
                    rows.append(i), numbers.append(number), sizes.append(counts[k]), out.append(found[k])
            held = [b.column(c).take(pa.array(rows, pa.int64())) for c in (id_col, "section", "title")]
            yield pa.RecordBatch.from_arrays([*held, pa.array(numbers, pa.int32()), pa.array(sizes, pa.int32()), pa.array(out, pa.string())], names=[id_col, "section", "title", "chunk_index", "token_count", "content"])

    own = sections.select(id_col, F.col("section").cast("bigint").alias("section"), "title", "content")
    found = own.mapInArrow(run, f"{id_col} {own.schema[id_col].dataType.simpleString()}, section bigint, title string, chunk_index int, token_count int, content string")
    return found.withColumns({"chunk_type": F.lit(kind), "chunk_id": F.concat_ws("_", id_col, T.slug(F.col("title")), "chunk_index")})
