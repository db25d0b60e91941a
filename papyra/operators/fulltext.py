"""Ranked full text over stems (FLT-06, TK-04): block postings with block maxima, and a top-k search that skips blocks.

Documents are dealt into ranges of about ``BLOCK`` documents of like length. A block holds a term's postings in a range (ids and weights);
its head, columns that are read without these, holds the number of postings and the largest weight. A posting's weight is
tf / (1 + ln(words of the document)), a document's rank for a question the sum of the weights of its terms, all of which it must hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.functions.stems import stem_of, stems
from papyra.session import removed, shared_folder, stored

BLOCK = 256
#: Ranges that a question reads at first, and by what the number grows from wave to wave.
FIRST, GROWTH = 2, 4
#: Folders by hash of the term: a search reads those of its terms only.
BUCKETS = 64
#: Relative room for sums of doubles in another order.
SLACK = 1e-9
#: Texts of an Arrow batch.
BATCH = 1000
SCHEMA = "term string, range bigint, n int, most double, ids array<bigint>, weights array<double>"
#: Columns of blocks that a search reads first.
HEADS = ("term", "range", "n", "most", "bucket")


def terms(c: Column, stop: Sequence[str] = T.STOP_WORDS) -> Column:
    """Stems of the words that are no stop words."""
    return stems(F.filter(T.words(F.coalesce(c, F.lit(""))), lambda w: ~w.isin(*stop)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, words, terms, tf) of texts that have words: each distinct word of a batch is stemmed once."""
    stop = frozenset(T.STOP_WORDS)
    for t in batches:
        lists = t.column("w")
        sizes = np.asarray(lists.value_lengths())
        coded = lists.flatten().dictionary_encode()
        stem = [None if w in stop else stem_of(w) for w in coded.dictionary.to_pylist()]
        number = {s: i for i, s in enumerate(dict.fromkeys(s for s in stem if s is not None))}
        code = np.asarray([-1 if s is None else number[s] for s in stem], np.int64)[np.asarray(coded.indices)]
        key, tf = np.unique((np.repeat(np.arange(len(sizes)), sizes) * max(len(number), 1) + code)[code >= 0], return_counts=True)
        ends = np.append(0, np.cumsum(np.bincount(key // max(len(number), 1), minlength=len(sizes)))).astype(np.int32)
        names = pa.array(list(number), pa.string()).take(pa.array(key % max(len(number), 1)))
        columns = [t.column("id"), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "words", "terms", "tf"]).filter(pa.array(sizes > 0))


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists, and the row of each."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten(), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))


def _blocks(t: pa.Table) -> pa.Table:
    """(term, range, ids, weights) of the documents of a range, by id."""
    (names, row), (tf, _) = _flat(t.column("terms")), _flat(t.column("tf"))
    coded, tf = names.dictionary_encode(), np.asarray(tf).astype(np.int64)
    term, doc, words = np.asarray(coded.indices).astype(np.int64), np.asarray(t.column("id"))[row], np.asarray(t.column("words"))[row]
    order = np.lexsort((words, doc, term))
    term, doc, words, tf = term[order], doc[order], words[order], tf[order]
    # rows of one id and length are one document
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]) | (words[1:] != words[:-1]))[: len(term)])
    tf = np.add.reduceat(tf, first) if len(first) else tf
    term, doc, words = term[first], doc[first], words[first]
    ends = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])[: len(term)]), len(term)).astype(np.int32)
    own = coded.dictionary.take(pa.array(term[ends[:-1]]))
    weight = tf / (1 + np.log(words.astype(float)))
    most = np.maximum.reduceat(weight, ends[:-1]) if len(own) else weight
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (doc, weight)]
    return pa.table([own, pa.array(np.full(len(own), t.column("range")[0].as_py(), np.int64)), pa.array(np.diff(ends)), pa.array(most), *lists], names=["term", "range", "n", "most", "ids", "weights"])


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    #: Postings that the last search read, and those that its terms have in all.
    postings_read: int = 0
    postings_held: int = 0

    @staticmethod
    def build(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> TextIndex:
        """Blocks of all documents; null and empty texts have no postings, ids are numbers."""
        spark = docs.sparkSession
        # a task writes to the folders of all buckets at once instead of sorting its blocks by bucket
        wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH), "spark.sql.maxConcurrentOutputFileWriters": str(BUCKETS)}
        before = {name: spark.conf.get(name) for name in wanted}
        try:
            for name, value in wanted.items():
                spark.conf.set(name, value)
            # dealt by document; terms are counted where the text is, and the postings of a range are made where its documents are
            texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text).repartition("id").select("id", T.words(F.coalesce(text, F.lit(""))).alias("w"))
            counted, folder = stored(texts.mapInArrow(_counted, "id bigint, words int, terms array<string>, tf array<int>"), "counted")
            # length classes are quarters of an octave, so there are some hundred at most; each is cut into ranges by hash of the id
            counted = counted.withColumn("kind", F.floor(4 * F.log2(F.col("words").cast("double"))).cast("int"))
            kinds = counted.groupBy("kind").agg(F.ceil(F.count("*") / BLOCK).alias("shares"))
            place = F.col("kind") * F.lit(1 << 32).cast("bigint") + F.pmod(F.xxhash64("id"), F.col("shares"))
            placed = counted.join(F.broadcast(kinds), "kind").select(place.alias("range"), "id", "words", "terms", "tf")
            blocks = placed.groupBy("range").applyInArrow(_blocks, SCHEMA)  # BLOCK documents, about
            blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
            blocks.write.partitionBy("bucket").parquet(f"{path}/blocks")
            removed(spark, folder)
        finally:
            for name, value in before.items():
                spark.conf.set(name, value)
        return TextIndex(spark, path)

    def _read(self, buckets: list[int]) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{self.path}/blocks").where(F.col("bucket").isin(buckets))

    def search(self, questions: DataFrame, k: int, id_col: str = "query_id", text: str = "query") -> DataFrame:
        """query_id, rank, id, score of the k best documents that hold all terms of a question.

        Blocks of the questions' terms are taken out of the index, and ranges of them are read in waves, those of the largest possible sum first. After a wave a
        question has a k-th best score, and ranges that can't reach it are never read. Questions without terms find nothing.
        """
        if self.spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            self.spark.sparkContext.setCheckpointDir(shared_folder(self.spark))
        asked = questions.select(F.col(id_col).alias("query_id"), F.array_distinct(terms(F.col(text))).alias("t"))
        asked = asked.select("query_id", F.size("t").alias("terms"), F.explode("t").alias("term")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).checkpoint()
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        heads = asked.join(self._read(buckets).select(*HEADS), ["bucket", "term"]).checkpoint()
        # the blocks of the search's terms are taken out once, not looked for again in every wave
        own, folder = stored(self._read(buckets).drop("n", "most").join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi"), "asked-blocks")
        bound = heads.groupBy("query_id", "range").agg(F.first("terms").alias("terms"), F.count("*").alias("held"), F.sum("most").alias("bound"), F.sum("n").alias("n"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
        whole = heads.agg(F.sum("n")).first()[0] or 0
        left = bound.where("held = terms").select("query_id", "range", "bound", "n", place.alias("place")).checkpoint()
        found, read, done, width = None, 0, 0, FIRST
        while True:
            wave = left.where((F.col("place") > done) & (F.col("place") <= done + width))
            if found is not None:
                least = found.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("score").alias("least")).where(F.col("hits") >= k).select("query_id", "least")
                open_ = left.where(F.col("place") > done).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") * (1 + SLACK) >= F.col("least")))
                if open_.isEmpty():
                    break
                wave = open_.where(F.col("place") <= done + width).select("query_id", "range", "bound", "n", "place")
            elif left.isEmpty():
                break
            wave = wave.select("query_id", "range", "n").checkpoint()
            read += wave.agg(F.sum("n")).first()[0] or 0
            met = wave.select("query_id", "range").join(asked, "query_id").join(own, ["bucket", "term", "range"])
            postings = met.select("query_id", "terms", F.explode(F.arrays_zip("ids", "weights")).alias("p"))
            hits = postings.groupBy("query_id", F.col("p.ids").alias("id")).agg(F.first("terms").alias("terms"), F.count("*").alias("held"), F.sum("p.weights").alias("score")).where("held = terms").select("query_id", "id", "score")
            both = hits if found is None else found.unionByName(hits)
            order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
            found = both.withColumn("o", order).where(F.col("o") <= k).drop("o").checkpoint()
            done, width = done + width, width * GROWTH
        removed(self.spark, folder)
        self.postings_read, self.postings_held = int(read), int(whole)
        if found is None:
            return self.spark.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
        return found.withColumn("rank", rank).select("query_id", "rank", "id", "score")
