"""Evaluation passages inside training text (problem 7).

A generalised suffix automaton is built over the words of the normalised test items.  Training
texts are streamed through it word by word: the automaton's state and the length of the longest
match that ends at each word are tracked, so every common passage is found in one pass whatever
its place or length.  Matches of at least ``min_words`` words are reported with all items that hold
them, and their spans can be removed.

The test items are a stated query set: they are taken in blocks of at most ``BLOCK_WORDS`` words,
one automaton each, so that what is broadcast is bounded; documents are never gathered.

Defined results for odd input:

* null and empty texts, and items of fewer than ``min_words`` words, match nothing;
* case, signs, spaces, line breaks, invisible characters and the composition of accents are ignored;
* repeated items are each reported; repeated documents each come out;
* a passage that several items share is reported for each of them.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import ignorable_class

#: Words of test items in one automaton; about 1 kB of memory a word.
BLOCK_WORDS = 500_000
MIN_WORDS = 14

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile(f"[{ignorable_class()}]")


@functools.cache
def _raw_word() -> re.Pattern:
    return re.compile(rf"(?:[^\W_]|[\u0300-\u036f{ignorable_class()}])+")


def _folded(text: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", _INVISIBLE.sub("", text)).casefold())


def words(text: str) -> list[str]:
    """The words of a text, normalised."""
    return _WORD.findall(text.lower() if text.isascii() else _folded(text))


def words_with_places(text: str) -> list[tuple[str, int, int]]:
    """The same words with their places in the text as recorded."""
    out = []
    for m in _raw_word().finditer(text):
        out += [(w, m.start(), m.end()) for w in _WORD.findall(_folded(m.group()))]
    return out


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of words, with the items of each state."""

    def __init__(self, items: Iterable[tuple[int, list[str]]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(i, w) for i, w in items if len(w) >= min_words]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.items: list[set[int]] = [set() for _ in self.link]
        for item, sequence in sequences:
            state = 0
            for word in sequence:
                state = self.next[state][word]
                up = state
                while up > 0 and item not in self.items[up]:
                    self.items[up].add(item)
                    up = self.link[up]
    def _state(self, length: int, link: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: str) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, word: str) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def matches(self, sequence: list[str]) -> list[tuple[int, int, int]]:
        """(end, words, state) of the longest match that ends at each word, where it is long enough.

        Every place counts: while a match with one item goes on, the shorter match with another item
        may have ended.
        """
        following, link, length, least = self.next, self.link, self.length, self.min_words
        found, state, n = [], 0, 0
        for i, word in enumerate(sequence, 1):
            to = following[state].get(word)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = following[state].get(word)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= least:
                found.append((i, n, state))
        return found

    def holders(self, sequence: list[str]) -> dict[int, int]:
        """Item: longest passage of it, in words."""
        out: dict[int, int] = {}
        for _, n, state in self.matches(sequence):
            # items of a shorter suffix hold a shorter passage
            while state and self.length[self.link[state]] < n and n >= self.min_words:
                for item in self.items[state]:
                    out[item] = max(out.get(item, 0), n)
                state = self.link[state]
                n = self.length[state]
        return out


LEAK_TYPE = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("words", T.IntegerType())]))
CLEAN_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("removed_words", T.IntegerType()), T.StructField("all_words", T.IntegerType())])


def _holders_column(shared):
    @F.pandas_udf(LEAK_TYPE)
    def holders(text: pd.Series) -> pd.Series:
        automaton = shared.value
        return pd.Series([[] if t is None else [{"item_id": i, "words": n} for i, n in automaton.holders(words(t)).items()] for t in text])

    return holders


def _cut_column(shared, coverage: float):
    @F.pandas_udf(CLEAN_TYPE)
    def cut(text: pd.Series) -> pd.DataFrame:
        automaton = shared.value
        rows = [(None, 0, 0) if t is None else (t, 0, 0) if not automaton.matches(words(t)) else cut_spans(t, automaton, coverage) for t in text]
        return pd.DataFrame(rows, columns=["text", "removed_words", "all_words"])

    return cut.asNondeterministic()  # else the optimizer copies it into a filter on the words removed


def _automata(items: DataFrame, min_words: int, block_words: int):
    """Broadcast automata over blocks of the items."""
    sc = items.sparkSession.sparkContext
    block, size = [], 0
    for row in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id").toLocalIterator():
        w = words(row.text)
        if block and size + len(w) > block_words:
            yield sc.broadcast(SuffixAutomaton(block, min_words))
            block, size = [], 0
        block.append((row.item_id, w))
        size += len(w)
    yield sc.broadcast(SuffixAutomaton(block, min_words))


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, words: the documents that hold a passage of an item, and its length."""
    texts = documents.where("text IS NOT NULL")
    parts = [texts.select("doc_id", F.explode(_holders_column(shared)("text")).alias("leak")).select("doc_id", "leak.item_id", "leak.words") for shared in _automata(items, min_words, block_words)]
    return functools.reduce(DataFrame.unionByName, parts)


def cut_spans(text: str, automaton: SuffixAutomaton, coverage: float) -> tuple[str, int, int]:
    """The text without the matched passages; empty where they cover too much of it."""
    placed = words_with_places(text)
    spans: list[list[int]] = []
    for end, n, _ in sorted(automaton.matches([w for w, _, _ in placed]), key=lambda m: m[0] - m[1]):
        if spans and end - n <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([end - n, end])
    removed = sum(b - a for a, b in spans)
    if not spans:
        return text, 0, len(placed)
    if removed >= coverage * len(placed):
        return "", removed, len(placed)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : placed[a][1]])
        at = placed[b - 1][2]
    return "".join(out) + text[at:], removed, len(placed)


def without_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All documents with the leaked passages cut out of ``text``.

    A document of which the passages cover ``coverage`` or more loses its whole text.  Adds
    ``removed_words``; documents without leaks stay as they are.
    """
    out = documents.withColumn("removed_words", F.lit(0))
    for shared in _automata(items, min_words, block_words):
        out = out.withColumn("leak_cut", _cut_column(shared, coverage)("text")).withColumns({"text": F.col("leak_cut.text"), "removed_words": F.col("removed_words") + F.col("leak_cut.removed_words")}).drop("leak_cut")
    return out
