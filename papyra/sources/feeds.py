"""Sources (SRC-01..21): Atom feeds, JSON records, stores, graphs, and a paged Python data source."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from papyra.functions.vocabulary import CATEGORIES

PAPER = (
    "id string, title string, authors array<string>, abstract string, doi string, published_date timestamp, updated_date timestamp, venue string, year int, "
    "categories array<string>, source string, url string, pdf_url string, hash string"
)
ENTRY = (
    "id string, title string, summary string, published string, updated string, author array<struct<name: string>>, doi string, "
    "link array<struct<_href: string, _title: string, _type: string>>, category array<struct<_term: string>>"
)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


def paper_hash(title: Column, first_author: Column) -> Column:
    return F.md5(F.concat_ws("_", F.lower(title), F.coalesce(F.lower(first_author), F.lit(""))))


def from_entries(entries: DataFrame) -> DataFrame:
    """SRC-01, SF-34: rows of Atom entries as papers; entries without id or title go."""
    names = F.transform(F.coalesce("author", F.array().cast("array<struct<name: string>>")), lambda a: squeeze(a["name"]))
    pdf = F.get(F.filter("link", lambda x: (x["_title"] == "pdf") | (x["_type"] == "application/pdf")), F.lit(0))["_href"]
    rows = entries.withColumns({"names": names, "t": squeeze(F.col("title")), "published_at": F.to_timestamp("published")})
    key = F.regexp_extract("id", r"([^/]+)$", 1)
    out = rows.select(
        key.alias("id"), F.col("t").alias("title"), F.col("names").alias("authors"), squeeze(F.col("summary")).alias("abstract"), "doi", F.col("published_at").alias("published_date"),
        F.to_timestamp("updated").alias("updated_date"), F.lit(None).cast("string").alias("venue"), F.year("published_at").alias("year"), F.transform("category", lambda c: c["_term"]).alias("categories"),
        F.lit("arxiv").alias("source"), F.col("id").alias("url"), pdf.alias("pdf_url"), paper_hash(F.col("t"), F.get("names", F.lit(0))).alias("hash"),
    )
    return out.where("id <> '' and title <> ''")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Saved feed pages; a page without entries gives no rows."""
    return from_entries(spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path))


def from_scholar(rows: DataFrame) -> DataFrame:
    """SRC-07, SF-35: records (title, authors string, year, abstract, venue, url, citations) in the papers' schema."""
    names = F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), r" and |, "), lambda s: F.trim(s)), lambda n: n != "")
    return rows.select(
        F.concat(F.lit("scholar_"), F.substring(F.md5("title"), 1, 12)).alias("id"), squeeze(F.col("title")).alias("title"), names.alias("authors"), F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.lit(None).cast("string").alias("doi"), F.make_date("year", F.lit(1), F.lit(1)).cast("timestamp").alias("published_date"), F.lit(None).cast("timestamp").alias("updated_date"), "venue",
        F.col("year").cast("int").alias("year"), F.array().cast("array<string>").alias("categories"), F.lit("scholar").alias("source"), "url", F.lit(None).cast("string").alias("pdf_url"),
        paper_hash(F.col("title"), F.get(names, F.lit(0))).alias("hash"),
    )


def in_category(papers: DataFrame, category: str, start: str, end: str) -> DataFrame:
    """SRC-02."""
    return papers.where(F.array_contains("categories", category) & F.col("published_date").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def by_author(papers: DataFrame, author: str) -> DataFrame:
    """SRC-04/08."""
    return papers.where(F.exists("authors", lambda a: F.contains(F.lower(a), F.lit(author.lower()))))


def advanced(papers: DataFrame, title: str | None = None, author: str | None = None, abstract: str | None = None, category: str | None = None) -> DataFrame:
    """SRC-05: all given conditions; none given is an error."""
    tests = []
    if title:
        tests.append(F.contains(F.lower("title"), F.lit(title.lower())))
    if author:
        tests.append(F.exists("authors", lambda a: F.contains(F.lower(a), F.lit(author.lower()))))
    if abstract:
        tests.append(F.contains(F.lower("abstract"), F.lit(abstract.lower())))
    if category:
        tests.append(F.array_contains("categories", category))
    if not tests:
        raise ValueError("at least one condition is needed")
    return papers.where(reduce(lambda a, b: a & b, tests))


def categories(spark: SparkSession) -> DataFrame:
    """SRC-06."""
    return spark.createDataFrame(list(CATEGORIES.items()), "category string, name string")


def read_metadata(spark: SparkSession, path: str, schema: str = PAPER) -> DataFrame:
    """SRC-15: one JSON object for each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """SRC-16: files holding one object from id to record; ``value`` is the record's DDL type."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("id", "r")).select("id", "r.*")


def read_citations(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """SRC-17: ``{"citations": [...]}``."""
    return spark.read.schema(f"citations array<struct<{fields}>>").option("multiLine", True).json(path).select(F.explode("citations").alias("c")).select("c.*")


def read_graph_json(spark: SparkSession, path: str, node: str = "id: string", edge: str = "source: string, target: string") -> tuple[DataFrame, DataFrame]:
    """SRC-18."""
    g = spark.read.schema(f"nodes array<struct<{node}>>, edges array<struct<{edge}>>").option("multiLine", True).json(path)
    return g.select(F.explode("nodes").alias("n")).select("n.*"), g.select(F.explode("edges").alias("e")).select("e.*")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-18: ids of nodes, and ends of edges, of a GraphML file."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string").load(path).select(F.col("_id").alias("id"))
    edges = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(path)
    return nodes, edges.select(F.col("_source").alias("source"), F.col("_target").alias("target"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13, SF-42: plain-text files as (id, text), the id from the file's name; PDF needs a library that isn't here."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("id"), F.decode("content", F.lit("UTF-8")).alias("text"))


def needs_ocr(text: Column, pages: Column) -> Column:
    """SRC-14, SF-30."""
    return F.coalesce(F.try_divide(F.length(text), 1000 * pages), F.lit(0.0)) < 0.1


class _Page(InputPartition):
    def __init__(self, start: int, size: int):
        self.start, self.size = start, size


class PagedSource(DataSource):
    """A feed read page by page, one partition for each page, with retries (SRC-01 live, SRC-20).

    Options: ``total``, ``page`` (rows of a page), ``fetch`` (dotted name of a function (start, size) -> rows), ``retries``,
    ``delay`` (seconds before the first retry; doubled each time).
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options.get("schema", "id string, title string")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.total, self.page = int(options["total"]), int(options.get("page", "100"))
        self.fetch, self.retries, self.delay = options["fetch"], int(options.get("retries", "3")), float(options.get("delay", "1"))

    def partitions(self) -> Sequence[InputPartition]:
        return [_Page(s, min(self.page, self.total - s)) for s in range(0, self.total, self.page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib
        import time

        module, _, name = self.fetch.rpartition(".")
        fetch = getattr(importlib.import_module(module), name)
        for attempt in range(self.retries + 1):
            try:
                rows = list(fetch(partition.start, partition.size))
                break
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(min(self.delay * 2**attempt, 60.0))
        yield from (tuple(r) for r in rows)
