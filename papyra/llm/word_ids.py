"""Token ids of whole texts by a public tokenizer file, with a table of words already encoded.

A tokenizer whose file has the normalizer, pre-tokenizer and word ends named below ends every pre-token at white space,
so a text's ids are the ids of its space-separated words one after another; only words not met before go through the
tokenizer. The ids are the same as those of one call over the whole text (``tests/llm`` compares them). With any other
file, texts go through the tokenizer whole.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Words kept; the table starts anew beyond it, which costs time but changes no id.
MOST_WORDS = 800_000
#: New words that one call to the tokenizer gets.
CALL_WORDS = 4096
#: Letters below this one have a lower case of one letter and no parts, whatever stands beside them.
SIMPLE_CASE = "\u0130"
END_ID = 1
MARK = "\x01"
WORD_END = "</w>"
#: The parts of a tokenizer file under which words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def word_by_word(path: str) -> bool:
    """Whether a tokenizer file is of the kind whose words can be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, special = found.get("model") or {}, [t["content"] for t in found.get("added_tokens") or []]
    same = (found.get("normalizer"), found.get("pre_tokenizer")) == (NORMALIZER, PRE_TOKENIZER)
    whole = model.get("type") == "BPE" and model.get("end_of_word_suffix") == WORD_END and not model.get("dropout") and not model.get("continuing_subword_prefix")
    return same and whole and all(t.startswith("<|") and " " not in t for t in special)


def stem(word: str) -> str:
    """The word that has the same ids, but for a final stop or comma cut off."""
    if len(word) > 1 and word[-1] in ".," and word[-2].isalpha() and word[-2] < SIMPLE_CASE:
        word = word[:-1]
    return word.lower() if word.isalpha() and (word.isascii() or max(word) < SIMPLE_CASE) else word


def plain_case(text: str) -> str:
    """Lower case where that is the tokenizer's own first step: Latin-1 letters, and no string that may be a special token."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


class WordIds:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = word_by_word(path)
        self.known: dict[str, bytes] = {"": b""}
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.ends = {c: self._whole(c) for c in ".,"}
        #: Whether a token ends a pre-token.
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith(WORD_END)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _cut(self, part: list[str], ids: np.ndarray, ends: np.ndarray, gap: int) -> None:
        """Take the ids of each word of a call, if there are as many as words."""
        if len(ends) != len(part):
            self.known.update((w, self._whole(w)) for w in part)
            return
        raw = ids.tobytes()
        begins = np.append(0, ends[:-1] + gap) * 4
        self.known.update(zip(part, map(lambda a, b: raw[a:b], begins.tolist(), (ends * 4).tolist())))

    def _learn(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]  # one pre-token each: its last token tells where it ends
        for i in range(0, len(letters), CALL_WORDS):
            part = letters[i : i + CALL_WORDS]
            ids = self._ids(" ".join(part))
            self._cut(part, ids, np.flatnonzero(self.last[ids]) + 1, 0)
        others = [w for w in words if not w.isalpha()]
        marked = [w for w in others if MARK not in w] if self.mark is not None else []
        for i in range(0, len(marked), CALL_WORDS):
            part = marked[i : i + CALL_WORDS]
            ids = self._ids(f" {MARK} ".join(part))
            self._cut(part, ids, np.append(np.flatnonzero(ids == self.mark), len(ids)), 1)
        for w in others if self.mark is None else (w for w in others if MARK in w):
            self.known[w] = self._whole(w)

    def _add(self, words: set[str]) -> None:
        """Learn words. A final stop or comma after a plain letter is a pre-token of its own, and case doesn't count."""
        stems = {w: stem(w) for w in words}
        self._learn(list(set(stems.values()).difference(self.known)))
        known, ends = self.known, self.ends
        for w, s in stems.items():
            if w != s:
                known[w] = known[s] + ends[w[-1]] if w[-1] in ends and s[-1] != w[-1] else known[s]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers; null is empty."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.asarray(f.ids, dtype="<u4").tobytes() for f in found]
        split = [plain_case(t or "").replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.known) if split else set()
        if len(self.known) + len(new) > MOST_WORDS:
            self.known = {"": b""}
            new = set().union(*split) - {""}
        self._add(new)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table for each worker process: tasks that follow find the words already there."""
    return WordIds(path)


def crc32_combine(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings one after the other, from their own CRCs and the second one's length."""

    def times(matrix: list[int], vector: int) -> int:
        total = i = 0
        while vector:
            if vector & 1:
                total ^= matrix[i]
            vector >>= 1
            i += 1
        return total

    def square(matrix: list[int]) -> list[int]:
        return [times(matrix, row) for row in matrix]

    shift = square(square([0xEDB88320] + [1 << i for i in range(31)]))  # four zero bits
    n = second_bytes
    while n:
        shift = square(shift)
        if n & 1:
            first = times(shift, first)
        n >>= 1
    return first ^ second
