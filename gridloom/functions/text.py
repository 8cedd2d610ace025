"""Text helpers shared by the operators: tests on characters and on Vietnamese syllables."""

from __future__ import annotations

import functools
import itertools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TONES = "̣̀́̃̉"

# The parts of a written Vietnamese syllable; syllables are built from them by rule.
_ONSETS = ["", *"b c ch d đ g gh gi h k kh l m n ng ngh nh p ph qu r s t th tr v x".split()]
_CODAS = "c ch m n ng nh p t".split()
_OPEN = (
    "a e ê i o ô ơ u ư y ia ya oa oe ua uê uơ uy uya ưa ai ao au ay âu ây eo êu iu iêu yêu oi ôi ơi oai oao oay oeo ui uôi uây uyu ưi ưu ươi ươu uao uai uya"
).split()
_CLOSED = "a ă â e ê i o ô ơ u ư y iê yê oa oă oe oo ôô ua uâ uê uô uy uyê ươ".split()


@functools.cache
def _toneless_syllables() -> tuple[frozenset[str], frozenset[str]]:
    """All toneless syllables, and those with a stopped coda (they take two tones only)."""
    free = {o + v for o, v in itertools.product(_ONSETS, _OPEN)} | {o + v + c for o, v, c in itertools.product(_ONSETS, _CLOSED, "m n ng nh".split())}
    stopped = {o + v + c for o, v, c in itertools.product(_ONSETS, _CLOSED, "c ch p t".split())}
    return frozenset(free), frozenset(stopped)


@functools.lru_cache(1 << 17)
def is_vietnamese_syllable(word: str) -> bool:
    """Whether the letters can be written as one Vietnamese syllable, accents included."""
    parts = unicodedata.normalize("NFD", word.lower())
    tones = [c for c in parts if c in TONES]
    if len(tones) > 1:
        return False
    bare = unicodedata.normalize("NFC", "".join(c for c in parts if c not in TONES))
    free, stopped = _toneless_syllables()
    return bare in free or bare in stopped and tones in (["́"], ["̣"])


def strip_accents(text: str) -> str:
    """Letters without their accents, đ as d."""
    parts = unicodedata.normalize("NFD", text)
    return "".join(c for c in parts if not unicodedata.combining(c)).replace("đ", "d").replace("Đ", "D")


#: Default-ignorable characters of the Unicode standard, as ranges; fixed values.
_IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]


@functools.cache
def ignorable_characters() -> str:
    return "".join(chr(c) for a, b in _IGNORABLE for c in range(a, b + 1))


@functools.cache
def ignorable_class() -> str:
    """The inside of a character class of a regular expression."""
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in _IGNORABLE)


@functools.cache
def ignorable_table() -> dict[int, None]:
    return dict.fromkeys(map(ord, ignorable_characters()))


@functools.cache
def space_table() -> dict[int, str]:
    """Every separator of the Unicode standard, mapped to the ordinary space."""
    return {c: " " for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]}


# Letters of other scripts and rare Latin letters beside the Latin letter they look like.
_CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ԚQ ԜW"
_GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ϲc ϳj"
_RARE_LATIN = "ɡg ɑa ıi ÐĐ ƉĐ ɩi ℓl"
LOOKALIKES: dict[str, str] = {x[0]: x[1] for x in f"{_CYRILLIC} {_GREEK} {_RARE_LATIN}".split()}


@functools.cache
def fold_pairs() -> tuple[str, str]:
    """Letters and signs beside their plain ASCII form: accented, full-width and look-alike ones, powers."""
    pairs = {c: LOOKALIKES[c] for c in LOOKALIKES}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = strip_accents(chr(code))
        if len(base) == 1 and base.isascii():
            pairs[chr(code)] = base
    pairs |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= {chr(c): " " for c in space_table()} | {"²": "2", "³": "3", "đ": "d", "Đ": "D", "Ð": "D", "Ɖ": "D", "–": "-", "—": "-", "\n": " ", "\t": " "}
    pairs = {a: (strip_accents(b) if b.isalpha() else b) for a, b in pairs.items()}
    return "".join(pairs), "".join(pairs.values())


def fold(column: Column) -> Column:
    """A header or unit in plain small ASCII letters: JVM-side, for look-ups."""
    source, target = fold_pairs()
    gone = f"[\u0300-\u036f{ignorable_class()}]"
    plain = F.lower(F.translate(F.regexp_replace(column, gone, ""), source, target))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def fold_text(text: str) -> str:
    """The same in Python."""
    source, target = fold_pairs()
    plain = "".join(c for c in text.translate(ignorable_table()) if not "̀" <= c <= "ͯ").translate(str.maketrans(source, target)).lower()
    return " ".join(plain.split())
