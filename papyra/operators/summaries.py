"""Map-reduce summaries and the sections that answer for parts of a summary (IR-32)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.session import shared_folder

#: Takes texts, gives a summary of each; one call for each Arrow batch.
Model = Callable[[Sequence[str]], Sequence[str]]

#: Title words by which a section answers for a part of a summary.
PARTS = {
    "methodology": ("method", "approach", "implementation"),
    "results": ("result", "finding", "experiment", "evaluation"),
    "conclusions": ("conclusion", "discussion", "future"),
}


def first_sentences(words: int, longer_than: int = 20) -> Model:
    """The model's stand-in: sentences of more than ``longer_than`` characters in order, as long as their words fit."""

    def run(texts: Sequence[str]) -> list[str]:
        out = []
        for t in texts:
            taken, used = [], 0
            for s in (x.strip() for x in t.split(".")):
                n = len(s.split())
                if len(s) <= longer_than:
                    continue
                if used + n > words:
                    break
                taken.append(s)
                used += n
            out.append(". ".join(taken) + "." if taken else "")
        return out

    return run


def _summarized(rows: DataFrame, model: Model, words: int, budget: int) -> DataFrame:
    """(id, i, text): each text through the model; an answer is cut to ``words`` words, and a text beyond the budget is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            if any(len(t.split()) > budget for t in texts):
                raise ValueError("a call of the model is over its budget")
            answers = [" ".join(a.split()[:words]) for a in model(texts)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("i"), pa.array(answers, pa.string())], names=["id", "i", "text"])

    return rows.select("id", "i", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, i bigint, text string")


def summarize(chunks: DataFrame, model: Model | None = None, words: int = 125, budget: int = 1000, id_col: str = "doc_id", order: str = "chunk_index", text: str = "content") -> DataFrame:
    """id, summary, levels, chunks: the chunks of a document summarized one by one, and neighbouring summaries again and again until one is left.

    No call of the model gets more than ``budget`` words: longer chunks are cut into parts of that size first, and a level joins ``budget // words``
    summaries (two at least, so ``budget`` must be twice ``words``), so a document of any number of chunks takes logarithmically many levels. Order is kept:
    a level joins those next to each other. Calls of a level run in parallel over all documents. Empty summaries are passed over; null texts are empty.
    """
    fan = budget // words
    if fan < 2:
        raise ValueError("the budget must hold two summaries")
    model = model or first_sentences(words)
    spark = chunks.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    listed = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\r]+"), lambda w: w != "")
    rows = chunks.select(F.col(id_col).alias("id"), F.col(order).cast("bigint").alias("at"), F.col(text).alias("text"), listed.alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / budget).cast("int") - 1, F.lit(0))), lambda p: F.array_join(F.slice("w", p * budget + 1, F.lit(budget)), " "))
    rows = rows.select("id", "at", F.posexplode(F.when(F.size("w") > budget, cut).otherwise(F.array(F.coalesce("text", F.lit(""))))).alias("part", "text"))
    # places without gaps, in order: a document's chunks are one array, no more than its words
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "part", "text"))).alias("p"))
    rows = listed.select("id", F.size("p").alias("chunks"), F.posexplode("p").alias("i", "x")).select("id", "chunks", F.col("i").cast("bigint").alias("i"), "x.text").checkpoint()
    counted = rows.where("i = 0").select("id", "chunks")
    level = _summarized(rows, model, words, budget).checkpoint()
    most, levels = counted.agg(F.max("chunks")).first()[0] or 0, 0
    while most > 1:
        group = F.floor(F.col("i") / fan)
        joined = level.groupBy("id", group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("l"))  # ``fan`` summaries
        kept = F.filter("l", lambda x: x["text"] != "")
        joined = joined.select("id", F.col("g").alias("i"), F.array_join(F.transform(kept, lambda x: x["text"]), "\n\n").alias("text"), (F.size(kept) > 1).alias("again"))
        again = _summarized(joined.where("again"), model, words, budget)
        level = again.unionByName(joined.where("not again").select("id", "i", "text")).checkpoint()
        most, levels = math.ceil(most / fan), levels + 1
    out = level.join(counted.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id")))
    need = F.when(F.col("chunks") <= 1, 0).otherwise(F.ceil(F.log(F.col("chunks").cast("double")) / math.log(fan) - 1e-9)).cast("int")
    return out.select(F.col("id").alias(id_col), F.col("text").alias("summary"), need.alias("levels"), F.col("chunks").cast("int").alias("chunks"))


def components(sections: DataFrame, id_col: str = "doc_id", order: str = "section", title: str = "title", content: str = "content", most: int = 500) -> DataFrame:
    """id and, for each of PARTS, the first section whose title names it, cut at ``most`` characters and followed by dots; empty where none does."""

    def first(terms: Sequence[str]) -> Column:
        named = F.lit(False)
        for t in terms:
            named = named | F.contains(F.lower(title), F.lit(t))
        found = F.min_by(F.when(named, F.struct(F.concat(F.substring(content, 1, most), F.lit("...")).alias("c"))), F.when(named, F.col(order)))
        return F.coalesce(found["c"], F.lit(""))

    return sections.groupBy(id_col).agg(*[first(terms).alias(name) for name, terms in PARTS.items()])


def key_points(summary: Column, most: int = 5) -> Column:
    """Bulleted, then numbered lines of a summary, the first ``most``."""
    bullets = F.regexp_extract_all(summary, F.lit(r"[•\-*]\s*(.+?)(?=\n|$)"), F.lit(1))
    numbers = F.regexp_extract_all(summary, F.lit(r"\d+\.\s*(.+?)(?=\n|$)"), F.lit(1))
    return F.slice(F.concat(bullets, numbers), 1, most)
