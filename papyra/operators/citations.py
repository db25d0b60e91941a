"""Citation text: reference sections, entries, parsed fields, in-text citations (IR-23..30, IR-36)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.functions.vocabulary import REFERENCE_HEADERS

#: Parts of a parse's confidence in the two forms of the reference.
STANDARD = {"doi": 0.3, "arxiv": 0.3, "year": 0.1, "venue": 0.1, "title": 0.2, "authors": 0.1}
STRUCTURED = {"doi": 0.4, "arxiv": 0.4, "year": 0.1, "structured": 0.3, "quoted": 0.2, "url": 0.1}
#: Ways of citing inside a text.
IN_TEXT = {
    "numeric": r"\[[0-9]+(?:, ?[0-9]+)*\]",
    "author_year": r"\([A-Z][\p{L}]+(?: et al\.)?,? (?:19|20)[0-9]{2}\)",
    "narrative": r"[A-Z][\p{L}]+ et al\. \((?:19|20)[0-9]{2}\)",
    "identifier": r"(?:doi:|arXiv:)[^ ,;\])]+",
}


#: What tells a line that is no title and a part that is no author, what stands between authors, and a line of names.
NOT_TITLES = ("arxiv:", "preprint", "submitted", "conference")
NOT_AUTHORS = ("university", "department", "email", "@")
BETWEEN_AUTHORS = (",", " and ", " & ", ";")
NAMES = r"[\p{L}\p{N}_](?:[ \t]+|[.,][ \t]*)[\p{L}\p{N}_]|&[ \t]+[\p{L}\p{N}_]"
BLANKS = " \t\n\r"


def reference_section(text: Column) -> Column:
    """IR-25: what follows a header line References or Bibliography, to an appendix or the end; the whole text without one."""
    found = F.regexp_extract(text, r"(?is)(?:^|\n)[ \t]*" + REFERENCE_HEADERS + r"[ \t]*\n(.*?)(?:\n[ \t]*(?:appendix|acknowledge?ments?)|$)", 1)
    return F.when(found != "", found).otherwise(text)


def entries(section: Column) -> Column:
    """IR-26: split at [n], (n) or n. if that gives more than three parts, else at blank lines, else at lines."""
    def clean(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"[ \t\n\r]+", " "))), lambda p: F.length(p) > 10)

    marks = [r"\[[0-9]+\]", r"\([0-9]{1,3}\) ", r"(?:^|\n)[0-9]{1,3}\. "]
    tried = [F.split(section, m) for m in marks]
    out = F.when(F.size(F.split(section, r"\n[ \t]*\n")) > 1, clean(F.split(section, r"\n[ \t]*\n"))).otherwise(clean(F.split(section, r"\n")))
    for parts in reversed(tried):
        out = F.when(F.size(parts) > 3, clean(parts)).otherwise(out)
    return out


def explode_entries(docs: DataFrame, id_col: str = "source_paper_id", text: str = "text") -> DataFrame:
    """(id, position, raw_text) of every reference entry."""
    return docs.select(id_col, F.posexplode(entries(reference_section(F.col(text)))).alias("position", "raw_text"))


def parse(rows: DataFrame, raw: str = "raw_text", weights: Mapping[str, float] = STANDARD) -> DataFrame:
    """IR-27/28: doi, arxiv_id, year, title, authors, venue and the sum of the weights of what was found, at most 1."""
    c = F.col(raw)
    rows = rows.withColumns({"doi": T.doi(c), "arxiv_id": T.arxiv_id(c), "year": T.year(c), "title": T.quoted_title(c), "authors": T.leading_authors(c), "venue": T.venue(c)})
    there = {
        "doi": F.col("doi").isNotNull(), "arxiv": F.col("arxiv_id").isNotNull(), "year": F.col("year").isNotNull(), "venue": F.col("venue").isNotNull(), "title": F.col("title").isNotNull(),
        "authors": F.col("authors").isNotNull(), "structured": c.rlike(r"[A-Z][\p{L}]+, [A-Z]\."), "quoted": c.rlike('"[^"]+"'), "url": c.rlike(r"https?://"),
    }
    score = sum((F.when(there[k], w).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return rows.withColumn("confidence", F.round(F.least(score, F.lit(1.0)), 6))


def identifiers(text: Column) -> tuple[Column, Column]:
    """IR-30: distinct DOIs and arXiv ids of a text, sorted."""
    dois = F.transform(F.regexp_extract_all(text, F.lit(T.DOI), F.lit(1)), lambda d: F.regexp_replace(d, r"[.,;)]+$", ""))
    return F.array_sort(F.array_distinct(dois)), F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(T.ARXIV), F.lit(1))))


def _citing(text: Column, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("cited"), F.lit(0.8).alias("confidence")))


def in_text(docs: DataFrame, id_col: str = "source_paper_id", text: str = "text", lines: int = 100) -> DataFrame:
    """IR-29: (id, kind, cited, confidence), the best of equal texts and kinds: four patterns (0.8), context cues (0.6), reference lines (0.9)."""
    c = F.col(text)
    found = [_citing(c, k, p) for k, p in IN_TEXT.items()]
    cues = F.filter(T.sentences(c), lambda s: F.lower(s).rlike(r"according to|as shown by|proposed by"))
    found.append(F.transform(cues, lambda s: F.struct(F.lit("context").alias("kind"), s.alias("cited"), F.lit(0.6).alias("confidence"))))
    refs = F.slice(F.filter(F.split(F.regexp_extract(c, r"(?is)\n[ \t]*references[ \t]*\n(.*)$", 1), "\n"), lambda x: F.length(x) > 20), 1, lines)
    found.append(F.transform(refs, lambda s: F.struct(F.lit("reference").alias("kind"), F.trim(s).alias("cited"), F.lit(0.9).alias("confidence"))))
    rows = docs.select(id_col, F.explode(F.concat(*found)).alias("f")).select(id_col, "f.*")
    return rows.groupBy(id_col, "kind", "cited").agg(F.max("confidence").alias("confidence"))


def numbered_entries(text: Column) -> Column:
    """IR-36: the texts after [n] marks."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[[0-9]+\] *([^\[\n]+)"), F.lit(1)), lambda s: F.trim(s))


def sections(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """IR-23: (id, section, level, title, content): lines grouped under the header before them; a text without headers is one section."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    lines = lines.withColumn("level", T.header_level(F.col("line")))
    w = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count("level").over(w))
    title = F.coalesce(F.max(F.when(F.col("level").isNotNull(), F.col("line"))), F.lit("Full Document"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("at", "line")))), lambda x: x["line"]), " ")
    return lines.groupBy(id_col, "section").agg(F.max("level").alias("level"), title.alias("title"), body.alias("content"))


def abstract(text: Column) -> Column:
    """SF-29."""
    return T.none_if_empty(F.trim(F.regexp_extract(text, r"(?is)abstract[:. \n]+(.*?)(?:\n[ \t]*\n|\n[ \t]*(?:1\.? )?introduction|$)", 1)))


def head_lines(text: Column) -> Column:
    """Of the first ten lines of a page, those that are not blank and no banner."""
    lines = F.slice(F.split(F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), "\n"), 1, 10)
    return F.filter(F.transform(lines, lambda x: F.trim(x, F.lit(BLANKS))), lambda x: (x != "") & ~T.any_of(F.lower(x), NOT_TITLES))


def page_title(lines: Column) -> Column:
    """IR-24: the first line of 11 to 199 characters; null without one."""
    return F.get(F.filter(lines, lambda x: F.length(x).between(11, 199)), F.lit(0))


def page_authors(lines: Column) -> Column:
    """IR-24, SF-27: names (ten at most) of the first line after the title that looks like names; null without one."""
    after = F.slice(lines, (F.array_position(lines, page_title(lines)) + 1).cast("int"), F.lit(10))
    line = F.get(F.filter(after, lambda x: x.rlike(NAMES)), F.lit(0))
    parts = reduce(lambda a, mark: F.flatten(F.transform(a, lambda x: F.transform(F.split(x, mark), lambda y: F.trim(y)))), BETWEEN_AUTHORS, F.array(line))
    names = F.slice(F.filter(parts, lambda x: F.length(x).between(3, 99) & ~T.any_of(F.lower(x), NOT_AUTHORS)), 1, 10)
    return F.when(line.isNotNull(), names)


def references(text: Column) -> Column:
    """SF-29: what follows References up to an appendix, else to the end, else what follows Bibliography; the first of over 100 characters, else null."""
    after = r"[ \t\n\r]*[:\-]?[ \t\n\r]*"
    tried = (rf"references{after}(.*?)\n[ \t\n\r]*(?:appendix|acknowledgment)", rf"references{after}(.*)", rf"bibliography{after}(.*)")
    found = [F.trim(F.regexp_extract(text, f"(?is){x}", 1), F.lit(BLANKS)) for x in tried]
    return F.coalesce(*[F.when(F.length(x) > 100, x) for x in found])
