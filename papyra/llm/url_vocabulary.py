"""URL filter: rules by host and path, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest fitting
rule decides. Urls without a rule are judged by their words: one strict term, or ``most_soft`` distinct soft terms,
rejects. A term counts only between boundaries (no ASCII letter or digit beside it). One automaton over all terms reads
a url once, whatever the size of the vocabulary.

Defined results: a null url, or one without ``://``, has empty host and path, no rule fits it, and its words are still
judged (null: none); repeated rows give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.shared import plain

Rule = tuple[str, str, str]

#: Rules of the query (verdict, host, path).
RULES: tuple[Rule, ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Vocabulary of the query.
STRICT = ("porn", "xxx", "casino", "viagra", "spam-farm", "malware", "phishing")
SOFT = ("adult", "bet", "bonus", "cheap", "free", "loan", "page", "ref", "sale", "spam", "track", "win")
MOST_SOFT = 2

SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[cut:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


class RuleTable:
    """Rules by host: a url looks up its host's suffixes only."""

    def __init__(self, rules: Sequence[Rule]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def longest(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, labels = (-1, None, None), host.split(".") if host else []
        for i in range(len(labels)):
            suffix = ".".join(labels[i:])
            for prefix, verdict in self.by_host.get(suffix, ()):
                if path.startswith(prefix) and len(suffix) + len(prefix) > best[0]:
                    best = (len(suffix) + len(prefix), suffix + prefix, verdict)
        return best[1], best[2]


class Vocabulary:
    def __init__(self, strict: Sequence[str], soft: Sequence[str], most_soft: int):
        import ahocorasick

        self.automaton, self.most_soft = ahocorasick.Automaton(), most_soft
        for term in soft:
            self.automaton.add_word(term, (term, False))
        for term in strict:
            self.automaton.add_word(term, (term, True))
        if len(self.automaton):
            self.automaton.make_automaton()

    def rejects(self, text: str) -> bool:
        soft, word = set(), lambda c: c.isascii() and c.isalnum()
        if not len(self.automaton):
            return False
        for end, (term, strict) in self.automaton.iter(text):
            start = end - len(term) + 1
            if (start and word(text[start - 1])) or (end + 1 < len(text) and word(text[end + 1])):
                continue
            if strict:
                return True
            soft.add(term)
            if len(soft) >= self.most_soft:
                return True
        return False


def _judge(rules: Sequence[Rule], strict: Sequence[str], soft: Sequence[str], most_soft: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words = RuleTable(rules), Vocabulary(strict, soft, most_soft)
        lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule, verdict = table.longest(host, path)
                out.append((host, path, rule, verdict or ("block" if words.rejects((url or "").translate(lower)) else "allow")))
            columns = [pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, most_soft: int = MOST_SOFT
) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; no shuffle, only the two columns are read."""
    return plain(pages, ("page_id", "url")).withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(_judge(rules, strict, soft, most_soft), SCHEMA)


def oracle_sql(rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, most_soft: int = MOST_SOFT) -> str:
    """The same judgement in DuckDB SQL."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    hit = lambda term: f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {values}),
parts AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
  translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM parts),
fit AS (SELECT h.page_id, h.url, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, max_by(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM hosts) h JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath) GROUP BY 1, 2)
SELECT h.page_id, h.host, h.path, f.rule AS rule,
  coalesce(f.verdict, CASE WHEN {' OR '.join(map(hit, strict))} OR {' + '.join(f"CAST({hit(t)} AS INT)" for t in soft)} >= {most_soft} THEN 'block' ELSE 'allow' END) AS verdict
FROM hosts h LEFT JOIN fit f ON f.page_id IS NOT DISTINCT FROM h.page_id AND f.url = h.url"""
