"""Languages of documents and of the passages inside them (problem 9).

Nearest-centroid classification: a sentence is a normalised TF-IDF vector of hashed character
n-grams and gets the language of the most similar of several clustered centroids per language, by
cosine; a sentence too far from all of them is rejected (``und``).  The centroids are fitted on a
bounded sample of labelled documents (``SAMPLE_PER_LANGUAGE``) and of their distinct complete
sentences (``SENTENCES_PER_LANGUAGE``, taken at even steps), in rounds that drop sentences whose
label another language's centroids contradict, so that wrong labels do no harm.  The other sentences
of the sample are held out and set the distance of rejection.  The weights of the n-grams are
counted over every sentence of every document.  Vietnamese typed without accents has centroids of
its own.  Classification covers every sentence of every document, in arrays over whole batches.

Defined results for odd input:

* null, empty and wordless texts have no segment and the document language ``und``, confidence 0;
* titles, list and bill lines and single terms are no complete sentences: they take part in a
  segment but do not make one;
* neighbouring sentences of one language form one segment, as do rejected ones (``und``, confidence
  0); a sentence rejected alone counts with a neighbour of the language nearest to it, else it joins
  the segment before it without counting; a title joins the one after it where none is before;
* ties go to the language that comes first in ``LANGUAGES``; repeated documents each come out.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import ignorable_class, strip_accents
from gridloom.session import bounded_rows

LANGUAGES = ("vi", "en", "fr", "de", "ja", "zh")
#: Codes and names by which a label names a language; fixed values.
LABELS = {
    "vi": "vi vie vn vietnamese vietnam viet tiếng_việt tieng_viet",
    "en": "en eng english anglais englisch tiếng_anh",
    "fr": "fr fra fre french français francais tiếng_pháp",
    "de": "de deu ger german deutsch allemand tiếng_đức",
    "ja": "ja jpn jp japanese 日本語 tiếng_nhật",
    "zh": "zh zho chi cn chinese 中文 汉语 漢語 tiếng_trung cmn",
}
UNKNOWN_LABELS = ("", "unknown", "und", "unk", "none", "null", "n/a", "na", "nan", "?", "-", "--", "other", "xx", "mul", "mis", "zxx", "undetermined", "undefined", "không rõ", "khong ro", "không xác định", "chưa rõ", "inconnu", "unbekannt")
#: Labelled documents per language from which the centroids are fitted.
SAMPLE_PER_LANGUAGE = 150
#: Distinct complete sentences of them per language; Vietnamese ones count once more without accents.
SENTENCES_PER_LANGUAGE = 350
CLUSTERS = 3
DIMENSIONS = 1 << 14
#: A sentence is rejected below this part of the cosine that all but a ``FAR_SHARE`` of the held-out
#: sentences of its language have; ``LEAST_COSINE`` stands where fewer than ``LEAST_HELD`` are held out.
REJECTED_PART, FAR_SHARE, LEAST_COSINE, LEAST_HELD = 0.8, 0.005, 0.08, 20
#: From here on characters are ideographs, kana and the like.
_FIRST_WIDE = 0x2E80
#: Sentences of a document that may be in the sample, and characters that such a sentence may have.
SAMPLE_SENTENCES, SAMPLE_CHARS = 40, 600
_CHUNK_CHARS = 80_000


def label_language(label: Column) -> Column:
    """The language that a recorded label names, in any code or spelling; null where it names none."""
    plain = F.lower(F.regexp_replace(label, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    base = F.regexp_extract(plain, r"^([^-_(/,;. ]+)", 1)
    spelled = F.regexp_replace(plain, " ", "_")
    # one text literal: the optimizer folds it to a map instead of a chain of comparisons
    codes = {s: code for code, spellings in LABELS.items() for s in spellings.split()}
    lookup = F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in codes.items())), F.lit("\n"), F.lit("\t"))
    return F.when(~plain.isin(*UNKNOWN_LABELS), F.coalesce(F.try_element_at(lookup, base), F.try_element_at(lookup, spelled), plain))


# ---------------------------------------------------------------- characters

_LETTER, _SMALL, _ALNUM, _SPACE, _DIGIT, _STOP, _CLOSER, _WIDE_STOP, _WIDE_CLOSER, _BULLET, _IGNORABLE = (1 << k for k in range(11))
_SIGNS = {_STOP: ".!?…", _CLOSER: "\"'”’»)]", _WIDE_STOP: "。！？", _WIDE_CLOSER: "」』）", _BULLET: "-*•|#"}
_INVISIBLE = re.compile(f"[{ignorable_class()}]")


def _kind(c: str) -> int:
    kind = _LETTER * (c.isalnum() and not c.isdecimal()) | _SMALL * c.islower() | _ALNUM * c.isalnum() | _SPACE * c.isspace() | _DIGIT * c.isdecimal() | _IGNORABLE * bool(_INVISIBLE.match(c))
    return kind | sum(flag for flag, signs in _SIGNS.items() if c in signs)


@functools.cache
def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind, and small letter (a space for all else), of each character of the basic plane."""
    every = [chr(c) for c in range(0x10000)]
    kinds = np.array([_kind(c) for c in every], np.uint16)
    return kinds, np.where(kinds & _LETTER, np.array([ord(c.lower()[:1] or c) for c in every], np.uint32), 32).astype(np.uint32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _kinds(codes: np.ndarray) -> np.ndarray:
    out = _character_tables()[0][np.minimum(codes, 0xFFFF)]
    for k in np.flatnonzero(codes > 0xFFFF):
        out[k] = _kind(chr(codes[k]))
    return out


def _small_letters(codes: np.ndarray) -> np.ndarray:
    out = _character_tables()[1][np.minimum(codes, 0xFFFF)]
    for k in np.flatnonzero(codes > 0xFFFF):
        c = chr(codes[k])
        out[k] = ord(c.lower()[0]) if _kind(c) & _LETTER else 32
    return out


# ---------------------------------------------------------------- sentences


def _running(flags: np.ndarray) -> np.ndarray:
    """Number of flags before each place."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


def _next(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first flag at or after each place, or the end."""
    at = np.append(np.flatnonzero(flags), len(flags))
    return at[np.searchsorted(at, places)]


def _blocks(codes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of runs of lines; a blank, titled or list line begins a new one."""
    inside = (codes != 10) & (codes != 13)
    edges = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(start):
        return start, stop
    gap = start[1:] - stop[:-1]
    joined = np.r_[False, ((gap == 1) & (codes[stop[:-1]] == 10)) | ((gap == 2) & (codes[stop[:-1]] == 13) & (codes[start[1:] - 1] == 10))]
    first = _next(kinds & _SPACE == 0, start)
    blank = first >= stop
    k = kinds[np.minimum(first, len(codes) - 1)]
    after = np.where(k & _DIGIT > 0, _next(kinds & _DIGIT == 0, first), first)
    sign = codes[np.minimum(after, len(codes) - 1)]
    listed = np.where(k & _DIGIT > 0, (sign == ord(".")) | (sign == ord(")")), k & _BULLET > 0) & (kinds[np.minimum(after + 1, len(codes) - 1)] & _SPACE > 0)
    begins = ~joined | blank | listed
    last = np.r_[np.flatnonzero(begins)[1:] - 1, len(start) - 1]
    return start[begins], stop[last]


def split_sentences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, complete) of the sentences of a text that ends with a line break.

    A line break ends a sentence only where a blank or a list line follows.  A sentence is complete
    when it ends as one, does not go on from another and has words enough to be no title or term.
    """
    kinds = _kinds(codes)
    block_start, block_stop = _blocks(codes, kinds)
    solid = _running(kinds & _SPACE == 0)
    ends, marks = [], []
    for stop, closer, spaced in ((_STOP, _CLOSER, True), (_WIDE_STOP, _WIDE_CLOSER, False)):
        flags = np.append(kinds & stop > 0, False)
        mark = np.flatnonzero(flags[:-1] & ~np.r_[False, flags[:-2]]) if len(codes) else np.zeros(0, np.int64)
        end = _next(~flags[:-1], mark)
        end = _next(kinds & closer == 0, end)
        able = kinds[np.minimum(end, len(codes) - 1)] & _SPACE > 0 if spaced else np.ones(len(end), bool)
        ends.append(end[able])
        marks.append(mark[able])
    end, mark = np.concatenate(ends), np.concatenate(marks)
    order = np.argsort(end, kind="stable")
    end, mark = end[order], mark[order]
    block = np.searchsorted(block_start, mark, "right") - 1
    # an ordinal at the beginning of a list line ends nothing
    before = np.where(np.r_[False, block[1:] == block[:-1]], np.r_[0, end[:-1]], block_start[block]) if len(end) else end
    n = solid[mark] - solid[before]
    ordinal = (n >= 1) & (n <= 3)
    for k in np.flatnonzero(ordinal):
        if not np.all(kinds[mark[k] - n[k] : mark[k]] & _DIGIT) or k and ordinal[k - 1] and block[k] == block[k - 1]:
            ordinal[k] = False
    end, block = end[~ordinal], block[~ordinal]
    # and what is left of each block
    stop = np.r_[end, block_stop]
    rest = np.r_[np.zeros(len(end), bool), np.ones(len(block_stop), bool)]
    block = np.r_[block, np.arange(len(block_stop))]
    order = np.lexsort((rest, stop))
    stop, rest, block = stop[order], rest[order], block[order]
    start = np.where(np.r_[False, block[1:] == block[:-1]], np.r_[0, stop[:-1]], block_start[block]) if len(stop) else stop
    held = ~rest | (solid[stop] > solid[start])
    start, stop, rest = start[held], stop[held], rest[held]

    def held_in(flags: np.ndarray, rare: bool = True) -> np.ndarray:
        count = np.flatnonzero(flags) if rare else _running(flags)
        return np.searchsorted(count, stop) - np.searchsorted(count, start) if rare else count[stop] - count[start]

    space = kinds & _SPACE > 0
    opens = ~space & np.r_[True, space[:-1]] if len(codes) else space
    words = held_in(opens, False) + (~space & ~opens)[start] if len(start) else start
    first = _next(kinds & _ALNUM > 0, start)
    goes_on = (first < stop) & (kinds[np.minimum(first, len(codes) - 1)] & _SMALL > 0) if len(start) else rest
    complete = ~rest & (held_in(codes == ord("|")) == 0) & ~goes_on & ((words >= 4) | (held_in((codes >= 0x3040) & (codes <= 0x9FFF)) >= 6))
    return start, stop, complete


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the sentences of one text."""
    start, stop, _ = split_sentences(_codes(text + "\n"))
    return list(zip(start.tolist(), stop.tolist(), strict=True))


def is_complete(sentence: str) -> bool:
    """Whether a sentence ends as one and has words enough not to be a title or a term."""
    start, stop, complete = split_sentences(_codes(sentence + "\n"))
    return len(start) == 1 and bool(complete[0])


def complete_sentences(text: str) -> list[str]:
    start, stop, complete = split_sentences(_codes(text + "\n"))
    return [text[a:b] for a, b in zip(start[complete].tolist(), stop[complete].tolist(), strict=True)]


# ---------------------------------------------------------------- vectors


def _composed(text: str) -> str:
    """Composed accents, no invisible characters."""
    return text if text.isascii() else unicodedata.normalize("NFC", _INVISIBLE.sub("", text))


def _plain(text: str) -> str:
    """Small letters, with a space for all else."""
    return " " + " ".join(re.sub(r"[\W\d_]+", " ", _composed(text).lower()).split()) + " "


class _Grams:
    """Hashed character n-grams of the words of texts, each word with a space on both sides.

    They are the 2- and 3-grams of letters and the 1- and 2-grams of ideographs and kana.

    ``text_of`` and ``which`` have the text and the distinct word of each word; ``hashed`` has the
    n-grams of distinct word k from ``start[k]`` to ``stop[k]``.
    """

    def __init__(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray):
        length = (stop - start).astype(np.int64) + 1
        after = np.cumsum(length)
        own = np.repeat(start - (after - length), length) + np.arange(length.sum())
        c = _small_letters(codes[np.minimum(own, max(0, len(codes) - 1))])
        c[after - 1] = 32
        letter = c != 32
        first, last = (np.flatnonzero(e) for e in (letter & ~np.r_[False, letter[:-1]], letter & ~np.r_[letter[1:], False]))
        length, text = last - first + 1, np.repeat(np.arange(len(start)), length)
        self.text_of = text[first]
        # of equal words the sums over their letters and the letters' places are equal
        place, word = _places(first, last + 1)
        mixed = (c[place].astype(np.uint64) << np.uint64(32)) + (place - first[word]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        self.signature = np.add.reduceat(mixed, np.cumsum(length) - length) if len(first) else np.zeros(0, np.uint64)
        _, chosen, self.which = np.unique(self.signature, return_index=True, return_inverse=True)
        # n-grams of the distinct words: two begin at each place, but for the ends
        place, word = _places(first[chosen], last[chosen] + 3)
        at = np.cumsum(length[chosen] + 2) - length[chosen] - 2
        padded = c[np.maximum(place - 1, 0)]
        padded[at] = 32
        padded[at + length[chosen] + 1] = 32
        inside, wide = padded != 32, padded >= _FIRST_WIDE
        two, other = table = np.zeros((2, len(padded)), np.uint32)
        two[:-1] = (padded[:-1] * np.uint32(0x85EBCA77) + padded[1:] * np.uint32(0xC2B2AE3D)) ^ np.uint32(0x27D4EB2F)
        other[:-2] = two[:-2] * np.uint32(0x165667B1) + padded[2:] * np.uint32(0xD3A2646C)
        other[wide] = padded[wide] * np.uint32(0x9E3779B1)
        table ^= table >> np.uint32(15)
        table *= np.uint32(0x2C1B3C6D)
        able = np.zeros(table.shape, bool)
        able[0, :-1] = inside[:-1] | inside[1:]
        able[1, :-2] = inside[1:-1] & ~wide[1:-1] & ~wide[:-2]
        able[1] |= wide
        able = able.T
        self.hashed = (table.T[able] >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int32)
        number = np.bincount(word, able.sum(1), len(chosen)).astype(np.int64)
        self.stop = np.cumsum(number)
        self.start = self.stop - number

    def counts(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, gram, count), sorted, of the texts with a flag."""
        chosen = np.flatnonzero(texts[self.text_of])
        which = self.which[chosen]
        place, number = _places(self.start[which], self.stop[which])
        kind = np.uint32 if len(texts) * DIMENSIONS < 1 << 32 else np.uint64
        keys = (self.text_of[chosen] * DIMENSIONS).astype(kind)[number] + self.hashed[place].astype(kind)
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        key = keys[first].astype(np.int64)
        return key // DIMENSIONS, key % DIMENSIONS, np.diff(np.r_[first, len(keys)])


def _places(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of spans, and the number of the span of each."""
    length = (stop - start).astype(np.int64)
    number = np.repeat(np.arange(len(start)), length)
    return np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length), number


def _grams_of_texts(texts: list[str]) -> _Grams:
    joined = _codes("\n".join(texts) + "\n")
    stop = np.cumsum([len(t) + 1 for t in texts]).astype(np.int64) - 1 if texts else np.zeros(0, np.int64)
    return _Grams(joined, np.r_[0, stop[:-1] + 1] if texts else stop, stop)


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hashed n-gram, count) of the n-grams of each text, sorted by text."""
    return _grams_of_texts(texts).counts(np.ones(len(texts), bool))


class _Sentences:
    """The sentences of a chunk of texts: start and stop within their text, whether complete."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.codes = _codes("\n\n".join(texts) + "\n\n")
        self.offset = np.r_[0, np.cumsum([len(t) + 2 for t in texts])[:-1]].astype(np.int64)
        self.start, self.stop, self.complete = split_sentences(self.codes)
        self.of = np.searchsorted(self.offset, self.start, "right") - 1

    def grams(self, chosen: np.ndarray):
        """(sentence numbers, grams) of chosen sentences; those to be composed come apart."""
        rough = np.array([not t.isascii() and not unicodedata.is_normalized("NFC", t) for t in self.texts], bool)
        rough[np.searchsorted(self.offset, np.flatnonzero(_kinds(self.codes) & _IGNORABLE), "right") - 1] = True
        rough = rough[self.of] if len(self.of) else np.zeros(0, bool)
        own = np.flatnonzero(chosen & ~rough)
        if len(own):
            yield own, _Grams(self.codes, self.start[own], self.stop[own])
        own = np.flatnonzero(chosen & rough)
        if len(own):
            at = self.offset[self.of[own]]
            places = zip(self.of[own], self.start[own] - at, self.stop[own] - at, strict=True)
            yield own, _grams_of_texts([_composed(self.texts[t][a:b]) for t, a, b in places])


def _chunks(texts: list[str]):
    """(first text, sentences) of texts in chunks, which bound what is held at a time."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= _CHUNK_CHARS):
            size += len(texts[stop])
            stop += 1
        yield start, _Sentences(texts[start:stop])
        start = stop


def _distinct_texts(grams: _Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where the words of each text with words begin, of equal texts the first, which of these each is)."""
    first = np.flatnonzero(np.r_[True, grams.text_of[1:] != grams.text_of[:-1]]) if len(grams.text_of) else grams.text_of
    signature = np.add.reduceat(grams.signature, first) if len(first) else grams.signature
    _, chosen, which = np.unique(signature, return_index=True, return_inverse=True)
    return first, chosen, which


class Centroids:
    """Clustered TF-IDF centroids of each language, and the least cosine that each language takes."""

    def __init__(self, idf: np.ndarray, matrix: np.ndarray, owners: np.ndarray, least: np.ndarray | None = None):
        self.idf, self.owners = idf, owners
        self.least = np.full(len(LANGUAGES), LEAST_COSINE, np.float32) if least is None else least
        self.weighted = np.ascontiguousarray((matrix * idf[None, :]).T, np.float32)

    def cosines(self, texts: list[str]) -> np.ndarray:
        """Cosine of each text with the nearest centroid of each language."""
        return self.nearest(_grams_of_texts(texts), len(texts))

    def nearest(self, grams: _Grams, n: int) -> np.ndarray:
        """The same of the ``n`` texts whose grams are given; equal words and texts are weighed once."""
        out = np.zeros((n, len(self.owners)), np.float32)
        if len(grams.text_of) and len(self.owners):
            of_word = np.add.reduceat(self.weighted[grams.hashed], grams.start, axis=0)
            first, distinct, same = _distinct_texts(grams)
            texts = grams.text_of[first]
            flags = np.zeros(n, bool)
            flags[texts[distinct]] = True
            number, gram, count = grams.counts(flags)
            norm = np.sqrt(np.bincount(number, (count * self.idf[gram]) ** 2, n))[texts[distinct]]
            words, of = _places(first[distinct], np.r_[first[1:], len(grams.text_of)][distinct])
            sums = np.add.reduceat(of_word[grams.which[words]], np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), axis=0)
            out[texts] = (sums / np.maximum(norm, 1e-9)[:, None])[same]
        best = np.full((n, len(LANGUAGES)), -1.0, np.float32)
        for k, owner in enumerate(self.owners):
            best[:, owner] = np.maximum(best[:, owner], out[:, k])
        return best


def _weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1


def _dense(texts: list[str], idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    number, term, count = _terms(texts)
    if idf is None:
        df = np.bincount(term, minlength=DIMENSIONS)
        idf = _weights(df, len(texts))
    rows = np.zeros((len(texts), DIMENSIONS), np.float32)
    rows[number, term] = count * idf[term]
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9), idf


def _clusters(rows: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means with deterministic, far-apart beginnings."""
    centres = [rows.mean(0)]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[np.argmin(np.max(rows @ np.array(centres).T, axis=1))])
    centres = np.array(centres)
    for _ in range(rounds):
        near = np.argmax(rows @ centres.T, axis=1)
        centres = np.array([rows[near == j].mean(0) if np.any(near == j) else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


def fit_centroids(sample: pd.DataFrame, clusters: int = CLUSTERS, rounds: int = 3, per_language: int = SENTENCES_PER_LANGUAGE, idf: np.ndarray | None = None) -> Centroids:
    """Fit on at most ``per_language`` sentences of a sample with the columns text and lang (one of ``LANGUAGES``).

    ``idf`` has the weights of the n-grams (``term_weights``); without it they are those of the
    sample.  The other sentences of the sample, a quarter at least, are held out: they set the cosine
    below which a sentence is rejected.
    """
    texts: list[str] = []
    labels: list[int] = []
    group: list[int] = []
    held: dict[int, list[str]] = {}
    for k, code in enumerate(LANGUAGES):
        every = list(dict.fromkeys(_plain(s) for t in sample.text[sample.lang == code] for s in complete_sentences(t)))
        most = min(per_language, len(every) - len(every) // 4)
        own = [t for n, t in enumerate(every) if n * most // max(1, len(every)) != (n + 1) * most // max(1, len(every))]
        left = sorted(set(every).difference(own))
        for part, form in ((2 * k, str), (2 * k + 1, strip_accents)) if code == "vi" else ((2 * k, str),):
            texts += map(form, own)
            labels += [k] * len(own)
            group += [part] * len(own)
            held[part] = [form(t) for t in left]
    if not texts:
        return Centroids(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64))
    rows, idf = _dense(texts, idf)
    label, part = np.array(labels), np.array(group)
    keep = np.ones(len(texts), bool)
    for n in range(rounds):
        # first one centroid per language: its right labels outweigh the wrong ones, which would
        # make a cluster of their own otherwise
        k = clusters if n else 1
        matrix, owners = [], []
        for g in np.unique(part):
            own = rows[keep & (part == g)]
            if len(own):
                centres = _clusters(own, k)
                # a centre that holds few sentences may be made of wrong labels
                share = np.bincount(np.argmax(own @ centres.T, axis=1), minlength=len(centres)) / len(own)
                centres = centres[share >= min(0.12, share.max())]
                matrix.append(centres)
                owners += [g // 2] * len(centres)
        centres, owned = np.concatenate(matrix), np.array(owners)
        keep = owned[np.argmax(rows @ centres.T, axis=1)] == label
    model = Centroids(idf, centres, owned)
    least = np.full(len(LANGUAGES), np.inf, np.float32)
    for g, own in held.items():
        cosines = model.cosines(own)
        top = cosines[cosines.argmax(1) == g // 2, g // 2]  # without wrong labels
        far = REJECTED_PART * np.quantile(top, FAR_SHARE) if len(top) >= LEAST_HELD else LEAST_COSINE
        least[g // 2] = min(least[g // 2], far)
    model.least = least
    return model


def _count_terms(batches):
    """Partial counts: of the sentences that hold each n-gram, and, as term -1, of all."""
    total, df = 0, np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        for _, chunk in _chunks(list(batch.text)):
            total += len(chunk.start)
            for own, grams in chunk.grams(np.ones(len(chunk.start), bool)):
                first, distinct, same = _distinct_texts(grams)
                texts = grams.text_of[first][distinct]
                times, flags = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
                times[texts], flags[texts] = np.bincount(same), True
                number, term, _ = grams.counts(flags)
                df += np.bincount(term, times[number], DIMENSIONS).astype(np.int64)
    held = np.flatnonzero(df)
    yield pd.DataFrame({"term": np.r_[-1, held].astype(np.int32), "n": np.r_[total, df[held]]})


def term_weights(documents: DataFrame) -> np.ndarray:
    """Weight of each n-gram by its share of all sentences of all documents."""
    counted = documents.where("text IS NOT NULL").select("text").mapInPandas(_count_terms, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    df, total = np.zeros(DIMENSIONS, np.int64), 0
    for r in counted.collect():  # at most DIMENSIONS + 1 rows
        if r.term < 0:
            total = r.n
        else:
            df[r.term] = r.n
    return _weights(df, total)


@F.pandas_udf(T.StringType())
def _sample_text(text: pd.Series) -> pd.Series:
    """Complete sentences of each text, at even steps, as paragraphs."""

    def some(t: str) -> str:
        own = [s for s in complete_sentences(t) if len(s) <= SAMPLE_CHARS]
        return "\n\n".join(own[:: max(1, math.ceil(len(own) / SAMPLE_SENTENCES))])

    return text.map(some)


def training_sample(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> pd.DataFrame:
    """text, lang: sentences of at most ``per_language`` labelled documents of each language.

    The documents are chosen by a hash of the id; each gives at most ``SAMPLE_SENTENCES`` sentences of
    at most ``SAMPLE_CHARS`` characters, so that what reaches the driver is bounded.
    """
    labelled = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", label_language(F.col("lang")).alias("lang")).where(F.col("lang").isin(*LANGUAGES))
    # hashes below a share of their range that holds several times the wanted number of each language
    count = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.coalesce(*(F.when(F.col("lang") == code, F.lit(min(1.0, (4 * per_language + 100) / n))) for code, n in count.items()), F.lit(0.0))
    part = F.pmod("hash", F.lit(1 << 40)) / (1 << 40)
    few = labelled.withColumn("hash", F.xxhash64(F.lit(7), "doc_id")).where(part < share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    chosen = few.withColumn("place", place).where(F.col("place") <= per_language).select("doc_id", "lang").dropDuplicates(["doc_id"])
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", _sample_text("text").alias("text"), "lang")
    return bounded_rows(texts, "language-sample").orderBy("doc_id", "text").toPandas()


# ---------------------------------------------------------------- segments

SEGMENTS_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("start_char", T.IntegerType()),
            T.StructField("end_char", T.IntegerType()),
            T.StructField("lang", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("sentences", T.IntegerType()),
        ]
    )
)


def _confidence(cosines: np.ndarray) -> np.ndarray:
    """Margin of the best over the second language, as a share of the best, in [0, 1]."""
    ordered = np.sort(cosines, axis=1)
    return np.clip((ordered[:, -1] - ordered[:, -2]) / np.maximum(ordered[:, -1], 1e-9), 0, 1)


def _vouched(code: np.ndarray, nearest: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Codes of complete sentences; -2 where rejected ones stand together, -1 where one stands alone.

    A sentence rejected by itself counts where a neighbour's language is the one nearest to it.
    """
    before, after = np.r_[-3, code[:-1]], np.r_[code[1:], -3]
    before[np.r_[True, of[1:] != of[:-1]]] = -3
    after[np.r_[of[1:] != of[:-1], True]] = -3
    rejected = code < 0
    code = np.where(rejected & ((before == nearest) | (after == nearest)), nearest, code)
    return np.where((code < 0) & ((before == -1) | (after == -1)), -2, code)


def segment_texts(texts: list[str | None], model: Centroids, least_cosine: float | None = None) -> list[list[dict]]:
    """Segments of each text; ``least_cosine`` stands in for what the model rejects by itself."""
    least = model.least if least_cosine is None else np.full(len(LANGUAGES), least_cosine, np.float32)
    present = [k for k, t in enumerate(texts) if t is not None]
    out: list[list[dict]] = [[] for _ in texts]
    for begin, chunk in _chunks([texts[k] for k in present]):
        n = len(chunk.start)
        if not n:
            continue
        # a sentence that is none goes with its neighbours, unless the text begins with it
        asked = chunk.complete | np.r_[True, chunk.of[1:] != chunk.of[:-1]]
        code, nearest, sure = np.full(n, -1), np.full(n, -1), np.zeros(n)
        for own, grams in chunk.grams(asked):
            cosines = model.nearest(grams, len(own))
            best = cosines.argmax(1)
            top = cosines[np.arange(len(own)), best]
            nearest[own] = np.where(top > 0, best, -3)
            code[own] = np.where(top >= least[best], best, -1)
            sure[own] = _confidence(cosines)
        whole = np.flatnonzero(chunk.complete)
        if len(whole):
            code[whole] = _vouched(code[whole], nearest[whole], chunk.of[whole])
        at = chunk.offset[chunk.of]
        for text, a, b, complete, k, confidence in zip(chunk.of.tolist(), (chunk.start - at).tolist(), (chunk.stop - at).tolist(), chunk.complete.tolist(), code.tolist(), sure.tolist(), strict=True):
            segments = out[present[begin + text]]
            lang = LANGUAGES[k] if k >= 0 else "und"
            last = segments[-1] if segments else None
            if last is not None and (not complete or k == -1 or lang == last["lang"] or not last["sentences"]):
                last["end_char"] = b
                if complete and k != -1:
                    if not last["sentences"]:  # a title goes with the text below it
                        last["lang"], last["weights"] = lang, []
                    last["sentences"] += 1
                    last["weights"].append((b - a, confidence))
            else:
                segments.append({"start_char": a, "end_char": b, "lang": lang, "sentences": int(complete and k != -1), "weights": [(b - a, confidence)]})
    for segments in out:
        for s in segments:
            w = s.pop("weights")
            s["confidence"] = 0.0 if s["lang"] == "und" else round(sum(n * c for n, c in w) / max(1, sum(n for n, _ in w)), 4)
    return out


def language_segments(documents: DataFrame, model: Centroids | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """All documents with ``segments`` and ``named``, the language that their label names."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit_centroids(training_sample(documents, per_language), idf=term_weights(documents)))

    @F.pandas_udf(SEGMENTS_TYPE)
    def segments(text: pd.Series) -> pd.Series:
        return pd.Series(segment_texts([None if t is None else t for t in text], shared.value))

    # else the optimizer copies it into a filter before the explosion and runs it twice
    segments = segments.asNondeterministic()
    return documents.withColumns({"segments": segments("text"), "named": label_language(F.col("lang"))})


def document_languages(documents: DataFrame, **options) -> DataFrame:
    """doc_id, lang, confidence, n_segments: the language with most text in each document."""
    found = language_segments(documents, **options)
    spans = F.transform("segments", lambda s: F.struct(s["lang"].alias("lang"), (s["end_char"] - s["start_char"]).alias("n"), s["confidence"].alias("c")))

    def total(place: int, code: str) -> Column:
        own = F.filter(spans, lambda s: s["lang"] == code)
        n = F.aggregate(own, F.lit(0), lambda a, s: a + s["n"])
        w = F.aggregate(own, F.lit(0.0), lambda a, s: a + s["n"] * s["c"])
        return F.struct(n.alias("n"), F.lit(-place).alias("place"), F.lit(code).alias("lang"), w.alias("w"))

    total_of = [total(k, code) for k, code in enumerate((*LANGUAGES, "und"))]
    return found.withColumn("top", F.array_max(F.array(*total_of))).select(
        "doc_id",
        F.when(F.coalesce("top.n", F.lit(0)) > 0, F.col("top.lang")).otherwise("und").alias("lang"),
        F.when(F.coalesce("top.n", F.lit(0)) > 0, F.round(F.col("top.w") / F.col("top.n"), 4)).otherwise(0.0).alias("confidence"),
        F.coalesce(F.size("segments"), F.lit(0)).alias("n_segments"),
    )


def unlabelled_languages(documents: DataFrame, least_sentences: int = 2, **options) -> DataFrame:
    """doc_id, lang: languages of passages of ``least_sentences`` sentences that the label does not name."""
    found = language_segments(documents, **options).select("doc_id", "named", F.explode("segments").alias("s"))
    return found.where((F.col("s.sentences") >= least_sentences) & (F.col("s.lang") != "und") & ~F.col("s.lang").eqNullSafe(F.col("named"))).select("doc_id", "s.lang").distinct()
