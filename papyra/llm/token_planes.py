"""Token ids in a binary chunk format: bit- or byte-plane shuffling, zstandard per plane, and a chunk index.

A chunk holds up to ``block_ids`` ids of consecutive documents. Its ids, little-endian unsigned 32-bit integers, are
transposed into planes: plane p of the bit form has bit p of every id, plane p of the byte form has byte p. Each plane
is compressed by itself, so the planes of high bits, which are nearly always zero, take a few bytes. Byte planes are the
form written unless bit planes are asked for: on the ids of documents they were smaller (87 against 102 kB a chunk) and faster. A chunk is

    magic ``PLN1`` | form u8 | planes u8 | reserved u16 | ids u32 | crc32 of the ids u32 | length of each plane u32 ... | planes

Chunks are rows of a Parquet table (binary column), written by Spark's own committer: a lost executor leaves no half
file, and any store that Spark reaches will do. The chunk index (partition, chunk, ids) is a second, small table.

Defined results: a null text is an empty text; an empty text has just the end id; a repeated row is a document of its
own; an empty table gives empty tables; other columns are ignored; a null id stands before all others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.llm.shared import Stored, ordered_key, plain, release, small_batches, text_slices
from papyra.llm.word_ids import END_ID, crc32_combine, word_ids

MAGIC = b"PLN1"
HEAD = struct.Struct("<4sBBHII")
BIT, BYTE = 0, 1
BLOCK_IDS = 1 << 16
LEVEL = 3

CHUNKS = "part int, chunk int, n_ids int, docs array<struct<seq: bigint, doc_id: bigint, at: int, n: int, first: boolean>>, data binary"
PIECES = "part int, seq bigint, doc_id bigint, start bigint, piece bigint, n bigint, crc bigint"


def encode_chunk(ids: np.ndarray, form: int = BYTE, level: int = LEVEL) -> bytes:
    """Planes of an array of ids, compressed one by one."""
    import zstandard

    ids = np.ascontiguousarray(ids, dtype="<u4")
    pack = zstandard.ZstdCompressor(level=level).compress
    raw = ids.view(np.uint8).reshape(-1, 4)
    if form == BYTE:
        planes = [pack(np.ascontiguousarray(raw[:, p]).tobytes()) for p in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little") if len(ids) else np.zeros((0, 32), np.uint8)
        planes = [pack(row.tobytes()) for row in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]
    head = HEAD.pack(MAGIC, form, len(planes), 0, len(ids), zlib.crc32(ids.tobytes()))
    return head + struct.pack(f"<{len(planes)}I", *map(len, planes)) + b"".join(planes)


def decode_chunk(data: bytes) -> np.ndarray:
    """The ids of a chunk; raises ValueError if it isn't whole."""
    import zstandard

    try:
        return _decoded(data, zstandard.ZstdDecompressor().decompress)
    except (struct.error, zstandard.ZstdError) as e:
        raise ValueError("a chunk of token planes is damaged") from e


def _decoded(data: bytes, unpack: Callable[[bytes], bytes]) -> np.ndarray:
    magic, form, n_planes, _, n, crc = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a chunk of token planes")
    lengths = struct.unpack_from(f"<{n_planes}I", data, HEAD.size)
    at, planes = HEAD.size + 4 * n_planes, []
    for length in lengths:
        planes.append(np.frombuffer(unpack(data[at : at + length]), dtype=np.uint8))
        at += length
    if form == BYTE:
        ids = np.stack(planes, axis=1).reshape(-1).view("<u4") if n else np.zeros(0, "<u4")
    else:
        bits = np.unpackbits(np.stack(planes), axis=1, count=n, bitorder="little") if n else np.zeros((32, 0), np.uint8)
        ids = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").reshape(-1).view("<u4")
    if len(ids) != n or zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a chunk of token planes is damaged")
    return ids


def _chunks(tokenizer: str, end_id: int, block_ids: int, form: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), word_ids(tokenizer)
        chunk, seq, held, size, docs = 0, 0, [], 0, []

        def flush() -> pa.RecordBatch:
            nonlocal chunk, held, size, docs
            row = {"part": part, "chunk": chunk, "n_ids": size, "docs": docs, "data": encode_chunk(np.frombuffer(b"".join(held), "<u4"), form)}
            chunk, held, size, docs = chunk + 1, [], 0, []
            return pa.RecordBatch.from_pylist([row], schema=SCHEMA)

        for batch in batches:
            for cut in text_slices(batch):
                for doc_id, raw in zip(cut.column("doc_id").to_pylist(), words.encode(cut.column("text").to_pylist())):
                    raw, at = raw + end, 0
                    while at < len(raw):
                        take = min(len(raw) - at, 4 * (block_ids - size))
                        docs.append({"seq": seq, "doc_id": doc_id, "at": size, "n": take // 4, "first": at == 0})
                        held.append(raw[at : at + take])
                        at, size = at + take, size + take // 4
                        if size == block_ids:
                            yield flush()
                    seq += 1
        if size:
            yield flush()

    return run


DOC = pa.struct([("seq", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("first", pa.bool_())])
SCHEMA = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int32()), ("docs", pa.list_(DOC)), ("data", pa.binary())])
PIECE_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("piece", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document's share of a chunk, from the chunk's decoded ids."""
    for batch in batches:
        for row, (part, chunk, base) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "base")))):
            raw, docs = memoryview(decode_chunk(batch.column("data")[row].as_py()).tobytes()), batch.column("docs").slice(row, 1).flatten()
            at, n, first = (np.asarray(docs.field(c)) for c in ("at", "n", "first"))
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist())]
            same = lambda v, kind: pa.array(np.full(len(at), v), kind)
            columns = [same(part, pa.int32()), docs.field("seq"), docs.field("doc_id"), pa.array(base + at.astype(np.int64), mask=~first), same(chunk, pa.int64()), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=PIECE_SCHEMA)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One CRC for the pieces of a document."""
    for batch in batches:
        lists = batch.column("pieces")
        begin = np.asarray(lists.offsets)
        flat = lists.values
        crc, n = np.asarray(flat.field("crc")), np.asarray(flat.field("n"))
        out = crc[begin[:-1]]
        for i in np.flatnonzero(np.diff(begin) > 1):  # few documents cross a chunk's end
            for j in range(begin[i] + 1, begin[i + 1]):
                out[i] = crc32_combine(int(out[i]), int(crc[j]), 4 * int(n[j]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _within(start: int, stop: int):
    """The ids of a chunk that lie in a range, and their first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases = batch.column("base").to_pylist()
            cut = [decode_chunk(d.as_py())[max(0, start - b) : max(0, stop - b)] for d, b in zip(batch.column("data"), bases)]
            yield pa.RecordBatch.from_arrays([pa.array([max(start, b) for b in bases], pa.int64()), pa.array([c.astype(np.int64) for c in cut], pa.list_(pa.int64()))], names=["start", "ids"])

    return run


@dataclass
class TokenPlanes:
    """The written files: ``chunks`` and the chunk ``index`` (part, chunk, n_ids)."""

    chunks: Stored
    index: Stored

    def bases(self) -> DataFrame:
        """(part, chunk, base): ids before each chunk. First within a part, then over one row for each part."""
        index = self.index.read()
        inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        before = index.groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("ids"))
        across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        before = before.select("part", F.coalesce(F.sum("ids").over(across), F.lit(0)).alias("before"))
        local = index.select("part", "chunk", F.coalesce(F.sum(F.col("n_ids").cast("long")).over(inside), F.lit(0)).alias("local"))
        return local.join(before, "part").select("part", "chunk", (F.col("local") + F.col("before")).alias("base"))

    def ids(self, start: int, stop: int) -> DataFrame:
        """(start, ids) of the places from ``start`` to before ``stop``, a row for each chunk that holds any; the index says which, and no other chunk is decoded."""
        wanted = self.bases().join(self.index.read(), ["part", "chunk"]).where((F.col("base") < stop) & (F.col("base") + F.col("n_ids") > start)).select("part", "chunk", "base")
        return self.chunks.read().select("part", "chunk", "data").join(wanted, ["part", "chunk"]).select("base", "data").mapInArrow(_within(start, stop), "start bigint, ids array<bigint>")

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, read back from the chunks."""
        chunks = self.chunks.read().join(self.bases(), ["part", "chunk"])
        pieces = chunks.select("part", "chunk", "base", "docs", "data").mapInArrow(_read, PIECES)
        grouped = pieces.groupBy("part", "seq").agg(
            F.first("doc_id").alias("doc_id"), F.max("start").alias("start"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("piece", "n", "crc"))).alias("pieces")
        )
        return grouped.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(_joined, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_token_planes(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, form: int = BYTE, partitions: int | None = None
) -> TokenPlanes:
    """Encode every text, append ``end_id``, and write the ids in ascending doc_id order.

    Rows are range-partitioned by id and sorted within a partition, so part after part and chunk after chunk gives the
    order of ids; a task holds one chunk at a time, however long a text is.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    rows = plain(docs, ("doc_id", "text")).withColumn("k", ordered_key("doc_id"))
    # as many parts as the input has splits, so that a part's size doesn't follow the corpus
    parts = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    rows = rows.repartitionByRange(parts, "k", F.xxhash64("text")).sortWithinPartitions("k", "text")
    chunks = Stored(rows.select("doc_id", "text").mapInArrow(_chunks(tokenizer, end_id, block_ids, form), CHUNKS), "token-planes", codec="none")
    index = Stored(chunks.read().select("part", "chunk", "n_ids"), "token-index")
    release(spark)
    return TokenPlanes(chunks, index)
