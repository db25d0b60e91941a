"""Best-fit packing by minimum bin slack over the table of lengths.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. How many pieces have each length is all that
packing needs, and that table has at most ``capacity`` rows at any corpus size. For one bin after another, a bitset
subset-sum over the lengths still there finds the fullest combination that holds the longest of them; the combination
is taken as often as the counts allow. Every combination uses up a length, so there are at most ``capacity`` of them.
Pieces then take places by their rank among the pieces of their length, in parallel: a combination that takes c pieces
of a length in each of its m bins owns c * m consecutive ranks.

Ranks come from counts by (length, salt): no length, however common, meets in one task.

Defined results: a null text is an empty text, an empty text is one piece holding the end id; repeated rows are
documents of their own (their pieces are interchangeable); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.shared import Stored, plain, release, small_batches, text_slices
from papyra.llm.word_ids import END_ID, word_ids

CAPACITY = 4096
#: Pieces that one (length, salt) group is meant to hold.
GROUP_ROWS = 50_000
#: Runs of files that are packed apart, at most, and the sequences that one fills at least.
MOST_WINDOWS, WINDOW_SEQUENCES = 16, 64
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"


def fullest(counts: dict[int, int], space: int) -> dict[int, int]:
    """Length -> number of pieces of the fullest combination within ``space``, longer lengths tried first."""
    reach, goal, full = 1, 1 << space, (1 << (space + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        if length > space:
            continue
        left, take = min(counts[length], space // length), 1
        while left and not reach & goal:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, take = left - take, take * 2
        if reach & goal:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def minimum_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(bins, length -> pieces in each) until no piece is left."""
    counts, plan = {n: c for n, c in counts.items() if c}, []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        chosen = fullest({n: c for n, c in rest.items() if c}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(counts[n] // c for n, c in chosen.items())
        plan.append((bins, chosen))
        for n, c in chosen.items():
            counts[n] -= c * bins
            if not counts[n]:
                del counts[n]
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces in a bin, offset), ordered by length and rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for bins, chosen in plan:
        offset = 0
        for n in sorted(chosen, reverse=True):
            rows.append((n, used.get(n, 0), base, chosen[n], offset))
            used[n] = used.get(n, 0) + chosen[n] * bins
            offset += n * chosen[n]
        base += bins
    return np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _cut(tokenizer: str, end_id: int, capacity: int, files: bool = False):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in batches:
            for cut in text_slices(batch):
                rows: list[tuple] = []
                numbers = cut.column("file").to_pylist() if files else [0] * cut.num_rows
                for doc_id, file, raw in zip(cut.column("doc_id").to_pylist(), numbers, words.encode(cut.column("text").to_pylist())):
                    raw += end
                    for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part), file))
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())[: None if files else 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "file"][: None if files else 5])

    return run


def _place(table: np.ndarray):
    """``table``: a row of ``places`` each, behind its window."""
    key = (table[:, 0] * (1 << 14) + table[:, 1] << 40) | table[:, 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            window, length, rank = (np.asarray(batch.column(c)).astype(np.int64) for c in ("window", "length", "rank"))
            row = table[np.searchsorted(key, (window * (1 << 14) + length << 40) | rank, side="right") - 1]
            nth = rank - row[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, windows: int = 1) -> DataFrame:
    """Places for rows (doc_id, piece, start, length, ids_crc32, window); ``pieces`` is read twice and must not change.

    Windows 0, 1, ... are packed apart, and their sequences follow each other, so sequences keep the order of windows; each costs one sequence more at most.
    """
    if not 1 <= windows <= MOST_WINDOWS or capacity >= 1 << 14:
        raise ValueError(f"1 to {MOST_WINDOWS} windows, and a capacity below {1 << 14}")
    counts: list[dict[int, int]] = [{} for _ in range(windows)]
    for w, n, c in pieces.groupBy("window", "length").count().collect():  # windows * capacity rows at most
        counts[w][int(n)] = int(c)
    tables, base = [], 0
    for w, own in enumerate(counts):
        plan = minimum_slack(own, capacity)
        table = places(plan)
        table[:, 2] += base
        tables.append(np.insert(table, 0, w, axis=1))
        base += sum(bins for bins, _ in plan)
    table = np.concatenate(tables)
    salts = max(8, sum(sum(own.values()) for own in counts) // GROUP_ROWS)
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = rows.groupBy("window", "length", "salt").agg(F.count("*").alias("n"))
    across = Window.partitionBy("window", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("window", "length", "salt", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("before"))
    inside = Window.partitionBy("window", "length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("nth", F.row_number().over(inside)).join(before, ["window", "length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "window", (F.col("before") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_place(table), PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, files_in_order: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. Texts are encoded once; the pieces are stored.

    ``files_in_order``: the files that ``docs`` is read from hold an order (a mix) by their numbers. Up to MOST_WINDOWS runs of files, of WINDOW_SEQUENCES
    sequences or more, are then packed one after another, so the sequences follow that order run by run. Rows that come from no file are one run.
    """
    rows = plain(docs, ("doc_id", "text"))
    if files_in_order:
        rows = rows.withColumn("file", F.coalesce(F.regexp_extract(F.input_file_name(), r"part-(\d+)[^/]*$", 1).try_cast("int"), F.lit(0)))
    small_batches(docs.sparkSession)
    pieces = Stored(rows.mapInArrow(_cut(tokenizer, end_id, capacity, files_in_order), PIECES + (", file int" if files_in_order else "")), "pieces")
    release(docs.sparkSession)
    if not files_in_order:
        return pack(pieces.read().withColumn("window", F.lit(0)), capacity)
    tokens, files = pieces.read().agg(F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max("file"), F.lit(0)) + 1).first()
    windows = int(max(1, min(MOST_WINDOWS, files, tokens // (capacity * WINDOW_SEQUENCES))))
    return pack(pieces.read().withColumn("window", F.floor(F.col("file") * windows / files).cast("int")), capacity, windows)
