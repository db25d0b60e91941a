"""Text expressions: tokens, normal forms, citation patterns, similarities (SF-01..42)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.vocabulary import ARXIV, DOI, PHRASES, STOP_WORDS, TECHNICAL, VENUES, YEAR

WORD = r"[\p{L}\p{N}]+"
GAP = r"[ \t\n\r]+"


def split_tokens(c: Column) -> Column:
    """Lower-case tokens between white space, as a keyword index sees them."""
    return F.filter(F.split(F.lower(c), GAP), lambda t: t != "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def keywords(c: Column, stop: Sequence[str] = STOP_WORDS, longer_than: int = 2) -> Column:
    """SF-15: words that are no stop words and long enough, in order."""
    return F.filter(words(c), lambda t: (F.length(t) > longer_than) & ~t.isin(*stop))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def jaccard(a: Column, b: Column) -> Column:
    """SF-16: of two token arrays; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    return F.lit(1.0) - F.coalesce(F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def normalize_title(c: Column) -> Column:
    """SF-01: lower case, no leading article, no trailing parentheses, punctuation to space, single spaces."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"^(the|a|an) ", "")
    c = F.regexp_replace(c, r" *\([^)]*\) *$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_ \t\n\r]", " "), r"[ \t\n\r]+", " "))


def normalize_authors(c: Column) -> Column:
    """SF-02."""
    c = F.regexp_replace(F.lower(F.trim(c)), r"et al\.?", "et al")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[.,]", " "), r" +", " "))


def author_names(c: Column) -> Column:
    """SF-03: names of an author string; separators are ``;`` and `` and ``; each name is normalised; short ones go."""
    parts = F.split(F.regexp_replace(c, r" +(and|&) +", ";"), ";")
    return F.filter(F.transform(parts, normalize_authors), lambda n: (F.length(n) > 2) & (n != "et al"))


def last_names(names: Column) -> Column:
    return F.transform(names, lambda n: F.get(F.split(n, " "), F.lit(0)))


def slug(c: Column, most: int = 50) -> Column:
    """SF-08."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_ \-]", ""), r"[ \-]+", "_"), 1, most)


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def doi(c: Column) -> Column:
    return none_if_empty(F.regexp_replace(F.regexp_extract(c, DOI, 1), r"[.,;)]+$", ""))


def arxiv_id(c: Column) -> Column:
    return none_if_empty(F.regexp_extract(c, ARXIV, 1))


def year(c: Column) -> Column:
    """First number that is a year from 1950 to 2039."""
    return none_if_empty(F.regexp_extract(c, YEAR, 1)).cast("int")


def quoted_title(c: Column) -> Column:
    """SF-06: between double quotes, else the first part between dots of 16 to 149 characters after the authors."""
    quoted = none_if_empty(F.regexp_extract(c, '"([^"]+)"', 1))
    parts = F.filter(F.transform(F.slice(F.split(c, r"\. "), F.lit(2), F.size(F.split(c, r"\. "))), lambda s: F.trim(s)), lambda p: F.length(p).between(16, 149))
    return F.coalesce(quoted, F.get(parts, F.lit(0)))


def leading_authors(c: Column) -> Column:
    """SF-07: what stands before the first full stop that ends a name list, 4 to 99 characters, entry number removed."""
    head = F.trim(F.regexp_extract(F.regexp_replace(c, r"^ *(\[[0-9]+\]|\([0-9]+\)|[0-9]+\.) *", ""), r"^([^\"0-9]*?[A-Z]\.)(?: |$)", 1))
    return F.when(F.length(head).between(4, 99), head)


def venue(c: Column) -> Column:
    """The first known name, in order of the lists."""
    return F.coalesce(*[none_if_empty(F.regexp_extract(c, p, 1)) for p in VENUES])


def normalize_phrases(c: Column) -> Column:
    """SF-09: lower case, then academic phrases in one form."""
    return reduce(lambda x, p: F.regexp_replace(x, f"(?i){p[0]}", p[1]), PHRASES, F.lower(c))


def entities(c: Column, technical: Sequence[str] = TECHNICAL) -> Column:
    """SF-14: capitalised words, and technical terms in capitals; a word that is both stands twice."""
    own = F.filter(F.split(c, GAP), lambda w: w != "")
    named = F.transform(own, lambda w: F.when((F.length(w) > 1) & (F.upper(F.substring(w, 1, 1)) == F.substring(w, 1, 1)) & F.substring(w, 1, 1).rlike(r"\p{L}"), w))
    known = F.transform(own, lambda w: F.when(F.lower(w).isin(*technical), F.upper(w)))
    return F.filter(F.flatten(F.zip_with(named, known, lambda a, b: F.array(a, b))), lambda w: w.isNotNull())


def estimate_tokens(c: Column) -> Column:
    """SF-31: a quarter of the characters."""
    return F.floor(F.length(c) / 4)


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    """SF-33 without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def cite_id(arxiv: Column, doi_: Column, paper_id: Column) -> Column:
    """PRJ-06."""
    return F.coalesce(F.concat(F.lit("arxiv:"), arxiv), F.concat(F.lit("doi:"), doi_), F.concat(F.lit("paper_"), paper_id.cast("string")))


def cite_type(c: Column) -> Column:
    """SF-24."""
    return F.when(c.startswith("arxiv:"), "arxiv").when(c.startswith("doi:"), "doi").otherwise("unknown")


def cite_url(c: Column) -> Column:
    return F.when(c.startswith("arxiv:"), F.concat(F.lit("https://arxiv.org/abs/"), F.substr(c, F.lit(7)))).when(c.startswith("doi:"), F.concat(F.lit("https://doi.org/"), F.substr(c, F.lit(5))))


def cited_in(c: Column) -> Column:
    """SF-25: distinct bracketed ids of an answer, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[([A-Za-z]+:[^\]]+)\]"), F.lit(1))))


def link_citations(answer: Column, ids: Column, shown: Column) -> Column:
    """SF-26: each id of an answer, bracketed, in parentheses or bare, letter case aside, becomes its shown form (folded over the array)."""
    quoted = lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}])", r"\\$1")
    pairs = F.arrays_zip(ids.alias("i"), shown.alias("s"))
    return F.aggregate(pairs, answer, lambda a, p: F.regexp_replace(a, F.concat(F.lit(r"(?iu)\["), quoted(p["i"]), F.lit(r"\]|\("), quoted(p["i"]), F.lit(r"\)|"), quoted(p["i"])), F.regexp_replace(p["s"], r"([\\$])", r"\\$1")))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, GAP, " "))


def clean_title(c: Column) -> Column:
    """SF-04: one line without a label before it and parentheses after it."""
    return F.regexp_replace(F.regexp_replace(one_line(c), r"(?i)^(?:title:|paper:|article:) *", ""), r" *\([^)]*\)$", "")


def clean_authors(c: Column) -> Column:
    """SF-04: one line without the punctuation at its end."""
    return F.regexp_replace(one_line(c), "[,. ]+$", "")


def normalize_citation(c: Column) -> Column:
    """SF-05: lower case, of signs only those of words and ``- . :``, no number at the start, one form of ``doi:``.

    Signs go first, so an address keeps its words without its slashes, as it does in the results to match.
    """
    c = F.regexp_replace(one_line(F.lower(c)), r"[^\p{L}\p{N}_ \-.:]", " ")
    return one_line(F.regexp_replace(F.regexp_replace(c, "^ *[0-9]+ *", ""), "doi:? *", "doi:"))


def clean_answer(c: Column, asked: Column) -> Column:
    """SF-11: a model's wording on one line without the quote at either end; null if that is empty or what was asked."""
    c = F.replace(F.regexp_replace(F.trim(c, F.lit(" \t\n\r")), "^[\"']|[\"']$", ""), F.lit("\n"), F.lit(" "))
    return F.when((c != "") & ~c.eqNullSafe(asked), c)


def any_of(c: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in terms])


def header_level(line: Column) -> Column:
    """SF-28: depth of a numbered header, 1 for all capitals, 2 for title case, else null."""
    number = F.regexp_extract(line, r"^([0-9]+(?:\.[0-9]+)*)\.? +\p{Lu}", 1)
    short = F.length(line).between(3, 80) & ~line.rlike(r"[.,;:!?]$")
    return (
        F.when(short & (number != ""), F.size(F.split(number, r"\.")))
        .when(short & line.rlike(r"^[\p{Lu}][\p{Lu} ]+$"), F.lit(1))
        .when(short & line.rlike(r"^(\p{Lu}\p{Ll}+)( \p{Lu}\p{Ll}+)*$"), F.lit(2))
    )
