"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared folder and
reads again for the next one. All but the last return the columns of ``documents``.

Odd rows, in every stage: a null or empty text is a document without words (rejected only if the classifier says so, near no other,
packed as its end id); null lang, source and n_chars are values of their own; a null doc_id stands before all others; repeated rows are near
duplicates, of which one stays; an empty table gives an empty table of the same columns; columns that ``documents`` doesn't have are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import bin_slack, co_training, pfair, prefix_join, queries, seed_extend
from papyra.llm.shared import Stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return co_training.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at five words and 0.8, the document with the smallest id stays."""
    return prefix_join.one_of_each(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that start earlier in the corpus are cut; every document stays, n_chars follows its text."""
    return seed_extend.remove_repeats(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return pfair.in_mixed_order(docs, queries.WEIGHTS, queries.DEFAULT_WEIGHT).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens; sequences follow the mix, run by run of its files."""
    return bin_slack.pack_documents(docs, queries.tokenizer_path(), files_in_order=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixed", mixed), ("packed", packed)]

#: SQL can express neither the classifier nor the tokenizer: tests compare the other stages, and the places of all pieces, with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stored = Stored(stage(spark, docs, sf_dir), f"stage-{name}")
        docs = stored.read()
        if before:
            before.drop()
        before = stored
    return docs
