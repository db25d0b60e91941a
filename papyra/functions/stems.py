"""English stems by suffix rules, as expressions and as SQL of the same rules (FLT-06).

The rules follow Porter's published algorithm ("An algorithm for suffix stripping", 1980): in each step the first rule whose
pattern fits is applied. A stem's measure, the number of vowel-consonant runs in it, is part of the pattern.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of a stem: it holds a vowel; a vowel-consonant run; two of them; it ends consonant-vowel-consonant, the last no w, x or y, and has one run.
VOWEL = r"(.*[aeiouy].*)"
ONE = r"(.*[aeiouy][^aeiouy].*)"
ONE_END = r"(.*[aeiouy][^aeiouy])"
TWO = r"(.*[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy].*)"
TWO_END = r"(.*[aeiouy][^aeiouy]+[aeiouy]+[^aeiouy])"
SHORT = r"([^aeiouy]*[aeiouy][^aeiouywx])"

#: Suffixes and what they become, by step of the algorithm.
LONG_SUFFIXES = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
MIDDLE_SUFFIXES = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
LAST_SUFFIXES = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _suffix(name: str, becomes: str, stem: str = ONE) -> tuple[tuple[str, str], ...]:
    """The rule, and that a word with the suffix but a shorter stem stays as it is: no shorter suffix is tried."""
    return (f"^{stem}{name}$", rf"\1{becomes}"), (f"^(.*{name})$", r"\1")


def _all(*rules: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    return [r for pair in rules for r in pair]


def _longest_first(suffixes: tuple[tuple[str, str], ...], stem: str) -> list[tuple[str, str]]:
    return _all(*(_suffix(name, becomes, stem) for name, becomes in sorted(suffixes, key=lambda x: (-len(x[0]), x))))


#: Steps of (pattern, replacement); a word of two letters or fewer is its own stem.
STEPS: tuple[list[tuple[str, str]], ...] = (
    [(r"^(.*)sses$", r"\1ss"), (r"^(.*)ies$", r"\1i"), (r"^(.*ss)$", r"\1"), (r"^(.*)s$", r"\1")],
    [
        *_suffix("eed", "ee"),
        *((rf"^{VOWEL}{x}$", r"\1+") for x in ("ed", "ing")),  # the plus asks the next step to mend the end
    ],
    [
        (r"^(.*(?:at|bl|iz))\+$", r"\1e"),
        (r"^(.*(?:ll|ss|zz))\+$", r"\1"),
        *((rf"^(.*{x}){x}\+$", r"\1") for x in "bcdfghjkmnpqrtvwx"),
        (rf"^{SHORT}\+$", r"\1e"),
        (r"^(.*)\+$", r"\1"),
    ],
    [(rf"^{VOWEL}y$", r"\1i")],
    _longest_first(LONG_SUFFIXES, ONE),
    _longest_first(MIDDLE_SUFFIXES, ONE),
    [*_longest_first(tuple((x, "") for x in LAST_SUFFIXES), TWO), (r"^(.*[aeiouy][^aeiouy]+[aeiouy]+(?:[^aeiouy]*[aeiouy]*)*[st])ion$", r"\1")],
    [(rf"^{TWO}e$", r"\1"), (rf"^{SHORT}e$", r"\1e"), (rf"^{ONE}e$", r"\1")],
    [(rf"^{TWO_END.replace('[^aeiouy])', 'l)')}l$", r"\1")],
)

#: Of each step: ends without which none of its rules fits, so that most words pass a step by one look.
ENDS = ("s$", "(?:ed|ing)$", r"\+$", "y$", f"(?:{'|'.join(x for x, _ in LONG_SUFFIXES)})$", f"(?:{'|'.join(x for x, _ in MIDDLE_SUFFIXES)})$", f"(?:{'|'.join(LAST_SUFFIXES)}|ion)$", "e$", "ll$")


def stems(words: Column) -> Column:
    """The stems of an array of lower-case words; words of other letters pass unless they end like English ones. A step is a lambda, so what it starts from is computed once."""

    def step(rules: list[tuple[str, str]], ends: str):
        def apply(x: Column) -> Column:
            out = x["w"]
            for pattern, becomes in reversed(rules):
                out = F.when(x["w"].rlike(pattern), F.regexp_replace(x["w"], pattern, becomes.replace(r"\1", "$1"))).otherwise(out)
            return F.struct(x["long"].alias("long"), F.when(x["long"] & x["w"].rlike(ends), out).otherwise(x["w"]).alias("w"))

        return apply

    out = F.transform(words, lambda w: F.struct((F.length(w) > 2).alias("long"), w.alias("w")))
    for rules, ends in zip(STEPS, ENDS):
        out = F.transform(out, step(rules, ends))
    return F.transform(out, lambda x: x["w"])


def stem(word: Column) -> Column:
    return F.element_at(stems(F.array(word)), 1)


#: ``ENDS`` as plain suffixes, which are looked up faster.
_SUFFIXES = (("s",), ("ed", "ing"), ("+",), ("y",), tuple(x for x, _ in LONG_SUFFIXES), tuple(x for x, _ in MIDDLE_SUFFIXES), (*LAST_SUFFIXES, "ion"), ("e",), ("ll",))
_COMPILED = tuple((ends, [(re.compile(pattern), becomes) for pattern, becomes in rules]) for rules, ends in zip(STEPS, _SUFFIXES))


@lru_cache(maxsize=1 << 18)
def stem_of(word: str) -> str:
    """The stem of one word, by the same rules: a task has far fewer words than it has places of words."""
    if len(word) <= 2:
        return word
    for ends, rules in _COMPILED:
        if word.endswith(ends):
            for pattern, becomes in rules:
                if found := pattern.match(word):
                    word = found.expand(becomes)
                    break
    return word


def stem_sql(word: str) -> str:
    """A common table expression's steps: select lists that turn ``word`` into its stem, one nested query for each step."""
    inner = f"SELECT {word} AS w0, {word} AS w FROM words_"
    for rules in STEPS:
        cases = " ".join(f"WHEN regexp_matches(w, '{p}') THEN regexp_replace(w, '{p}', '{b}')" for p, b in rules)
        inner = f"SELECT w0, CASE {cases} ELSE w END AS w FROM ({inner})"
    return f"SELECT w0 AS word, CASE WHEN length(w0) <= 2 THEN w0 ELSE w END AS stem FROM ({inner})"
