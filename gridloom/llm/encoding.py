"""Text decoded with a wrong character encoding (problem 3).

Round-trip repair: the text is encoded again under a candidate wrong encoding and strictly decoded
as the intended one, layer after layer; a step is accepted where a garbling cost drops.  The cost
of a text is the sum over its words: a valid Vietnamese syllable, plain ASCII and common signs
cost nothing; letters that no language of the data joins, signs inside words, control characters,
box drawing and replacement characters cost much.  Multi-byte garbling is repaired run by run,
single-byte legacy encodings over the stretch of words with the greatest drop, so that partly
garbled texts come out whole.  Each distinct value of a batch is repaired once.

Defined results for odd input:

* null, empty and plain ASCII text without a question mark inside a word is clean, as is one with a
  single word of that kind that is no Vietnamese one (an address, a missing space);
* ``status`` is ``restored`` (original text in ``restored``), ``partial`` (some characters are
  lost; the rest is restored) or ``lost`` (nothing can be had, ``restored`` is null);
* the recorded encoding_status and encoding_evidence are not used: they are unreliable;
* repeated rows come out once.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import is_vietnamese_syllable

# The TCVN3 (ABC) code page, byte by byte.
_TCVN3_BYTES = (
    "A1Ă A2Â A3Ê A4Ô A5Ơ A6Ư A7Đ A8ă A9â AAê ABô ACơ ADư AEđ B5à B6ả B7ã B8á B9ạ BBằ BCẳ BDẵ BEắ C6ặ C7ầ C8ẩ C9ẫ CAấ CBậ CCè CEẻ CFẽ D0é D1ẹ "
    "D2ề D3ể D4ễ D5ế D6ệ D7ì D8ỉ DCĩ DDí DEị DFò E1ỏ E2õ E3ó E4ọ E5ồ E6ổ E7ỗ E8ố E9ộ EAờ EBở ECỡ EDớ EEợ EFù F1ủ F2ũ F3ú F4ụ F5ừ F6ử F7ữ F8ứ F9ự FAỳ FBỷ FCỹ FDý FEỵ"
)
# VNI marks, written after their letter, as combining accents; and its single letters.
_VNI_MARKS = {"ù": "́", "ø": "̀", "û": "̉", "õ": "̃", "ï": "̣", "â": "̂", "á": "̂́", "à": "̂̀", "å": "̂̉", "ã": "̂̃", "ä": "̣̂", "ê": "̆", "é": "̆́", "è": "̆̀", "ú": "̆̉", "ü": "̆̃", "ë": "̣̆"}
_VNI_LETTERS = {"ô": "ơ", "ö": "ư", "ñ": "đ", "í": "í", "ì": "ì", "æ": "ỉ", "ó": "ĩ", "ò": "ị", "î": "ỵ"}
_VNI_BASES = "aeiouyôöAEIOUYÔÖ"

#: Encodings by which multi-byte text is wrongly read, and the intended ones of the single-byte cases.
WRONG = ("cp1252", "mac_roman", "cp437", "cp850", "cp1258", "cp1250", "cp1251", "cp1254", "cp874", "latin_1")
CJK = ("cp932", "euc_jp", "gb18030", "big5")
PAIRS = (("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1258", "cp1252"), ("cp850", "cp1258"), ("cp437", "cp1258"), ("cp437", "cp850"))
#: A step must lower the cost by this much at least.
LEAST_DROP = 1.0
MAX_LAYERS = 4

_FRENCH_GERMAN = frozenset("àâäçéèêëîïôöùûüœæßñ")
_SIGNS_IN_WORDS = frozenset("'’‘-–./+&_")
_PLAIN_SIGNS = frozenset("≤≥±×÷½¼¾°²³µØΦ–—“”‘’«»…•₫€§№′″")
_WORD = re.compile(r"[^\W\d_²³¹¼½¾]+")
_LONE = frozenset("ØΦφµđĐøñæœßà")
#: A diameter before or degrees after a number.
_LOST_SIGN = re.compile(r"(?<!\S)\?(?=\d)|(?<=\d)\?(?=\s+[a-z])")
_LOST_POWER = re.compile(r"(?<=\d)\s?[^\W\d_]{1,2}\?(?=[\s,.;)]|$)")
_LOST_LETTER = re.compile(r"(?<=[^\W\d_])\?+(?=[^\W_])|(?<!\S)\?+(?=[^\W\d_]{1,})|(?<=[^\W\d_])\?{2,}|(?<=\d)\s?[^\W\d_]{1,2}\?(?=[\s,.;)]|$)|(?<!\S)\?{2,}(?!\S)")


_TOKEN_WITH_MARK = re.compile(r"\S*\?\S*")
_PART_WITH_MARK = re.compile(r"(?:[^\W\d_]|\?)+")


@functools.lru_cache(1 << 14)
def _may_have_lost(token: str) -> bool:
    """Whether a word becomes a Vietnamese syllable with letters in place of its question marks."""
    for part in _PART_WITH_MARK.findall(token.lower()):
        n = part.count("?")
        if 0 < n < len(part) and (n > 3 or any(is_vietnamese_syllable(part.replace("?", "%s") % letters + tone) for letters in itertools.product("aăâeêioôơuưyđ", repeat=n) for tone in ("", "\u0301"))):
            return True
    return False


def _lost_letters(text: str) -> bool:
    """Question marks that stand for lost letters: in a word that may be Vietnamese, at a number, or in several words."""
    if "?" not in text:
        return False
    if _LOST_SIGN.search(text):
        return True
    found = [m.start() for m in _LOST_LETTER.finditer(text)]
    if not found:
        return False
    words = [m.group() for m in _TOKEN_WITH_MARK.finditer(text) if any(m.start() <= k < m.end() for k in found)]
    return len(words) > 1 or any(map(_may_have_lost, words)) or bool(_LOST_POWER.search(text))


@functools.cache
def _charmap(encoding: str) -> tuple[dict[str, int], dict[int, str]]:
    """A single-byte code page both ways; bytes without a character stand for themselves."""
    forth = {}
    for b in range(256):
        try:
            forth[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            forth[b] = chr(b)
    return {c: b for b, c in reversed(forth.items())}, forth


def _to_bytes(text: str, encoding: str) -> bytes | None:
    back = _charmap(encoding)[0]
    try:
        return bytes(back[c] for c in text)
    except KeyError:
        return None


@functools.cache
def _tcvn3() -> dict[str, str]:
    cp1252 = _charmap("cp1252")[1]
    return {cp1252[int(x[:2], 16)]: x[2] for x in _TCVN3_BYTES.split()}


def _match_case(word: str, original: str) -> str:
    """Capitals of the .VnTimeH fonts use the codes of small letters."""
    plain = [c for c in original if c.isascii() and c.isalpha()]
    return word.upper() if len(plain) >= 2 and all(c.isupper() for c in plain) and sum(map(str.isupper, word)) * 2 >= len(plain) else word


def _from_tcvn3(word: str) -> str | None:
    table = _tcvn3()
    if word.startswith("µ") or word in _PLAIN_SIGNS:
        return word
    if any(not c.isascii() and c not in table and c not in _PLAIN_SIGNS for c in word):
        return None
    return _match_case("".join(table.get(c, c) for c in word), word)


def _from_vni(word: str) -> str | None:
    out: list[str] = []
    for c in word:
        low = c.lower()
        if out and low in _VNI_MARKS and out[-1][-1:] in ("a", "e", "i", "o", "u", "y", "ơ", "ư", "A", "E", "I", "O", "U", "Y", "Ơ", "Ư"):
            out[-1] = unicodedata.normalize("NFC", out[-1] + _VNI_MARKS[low])
            if len(out[-1]) > 1:
                return None
        elif low in _VNI_LETTERS:
            out.append(_VNI_LETTERS[low] if c == low else _VNI_LETTERS[low].upper())
        elif c.isascii() or c in _PLAIN_SIGNS:
            out.append(c)
        else:
            return None
    return "".join(out)


def _pair(wrong: str, right: str, word: str) -> str | None:
    raw = _to_bytes(word, wrong)
    if raw is None:
        return None
    try:
        return unicodedata.normalize("NFC", raw.decode(right))
    except UnicodeDecodeError:
        return None


#: Accents after a vowel that neither French nor German write: what VNI marks look like.
_AFTER_VOWEL = re.compile(r"[aeiouy][âàåãä]|[aeiuy]ù|[aeiuy]û|aï[^sfvrqn]|(?<!o)uï|[ae]ô|[iuy]ø|[aeiouy]á")


@functools.lru_cache(1 << 16)
def _letters_cost(word: str) -> float:
    """Cost of a run of letters."""
    word = word.removeprefix("µ")
    if word.isascii() or word in _LONE:
        return 0.0
    if is_vietnamese_syllable(word):
        return 0.0 if word.islower() or word.isupper() or word.istitle() or word[1:].islower() else 1.0
    cost = 0.0
    marks = [c for c in word if not c.isascii()]
    cjk = [c for c in marks if "぀" <= c <= "ヿ" or "一" <= c <= "鿿" or c in "々ー〇"]
    if cjk:
        foreign = len(word) - len(cjk)
        rare = sum(1 for c in cjk if "一" <= c <= "鿿" and not _common_ideograph(c))
        return 0.5 * rare + (1.5 if 0 < foreign and any(c not in cjk for c in marks) else 0.0)
    if any("｡" <= c <= "ﾟ" for c in marks):
        return 0.5 * len(marks)
    if any("Ͱ" <= c <= "֏" or "ἀ" <= c <= "῿" or "＀" <= c <= "￯" for c in marks):
        # look-alike and full-width letters are another problem's
        return 0.6 if any(c.isascii() for c in word) else 0.3
    low = word.lower()
    if all(c.isascii() or c in _FRENCH_GERMAN for c in low):
        cost += 0.15 if len(marks) * 2 <= len(word) else 1.5
        if _AFTER_VOWEL.search(low):
            cost += 1.0
        elif is_vietnamese_syllable(low + "́"):  # a stopped syllable without its tone
            cost += 0.45
    else:
        cost += 1.2 + 0.3 * len(marks)
    if not (word.islower() or word.isupper() or word[1:].islower()):
        cost += 1.2
    return cost


@functools.lru_cache(1 << 14)
def _common_ideograph(c: str) -> bool:
    """First-level ideographs of the Japanese or Chinese standard."""
    for encoding, low, high in (("cp932", 0x88, 0x97), ("gb2312", 0xB0, 0xD7)):
        try:
            if low <= c.encode(encoding)[0] <= high:
                return True
        except UnicodeEncodeError:
            pass
    return False


@functools.lru_cache(1 << 17)
def word_cost(word: str) -> float:
    """Garbling cost of a word between spaces."""
    if word.isascii() and "?" not in word and word.isprintable():
        return 0.0
    word = unicodedata.normalize("NFC", word)
    cost = sum(_letters_cost(m.group()) for m in _WORD.finditer(word))
    for i, c in enumerate(word):
        code = ord(c)
        if code < 0x80:
            if code < 0x20 or code == 0x7F:
                cost += 2.0
            continue
        if c == "�":
            cost += 2.0
        elif 0x80 <= code < 0xA0 or 0x2500 <= code < 0x25A0 or 0xE000 <= code < 0xF900:
            cost += 2.0
        elif c.isalpha() or unicodedata.combining(c):
            continue
        elif code in (0xA0, 0xAD) or 0x2000 <= code <= 0x200F or 0x2028 <= code <= 0x202F or code in (0x3000, 0xFEFF, 0x2060):
            cost += 0.1
        elif 0x3001 <= code <= 0x303F or 0xFF01 <= code <= 0xFF65:
            cost += 0.0
        else:
            inside = (0 < i and word[i - 1].isalpha()) + (i + 1 < len(word) and word[i + 1].isalpha())
            if c in _PLAIN_SIGNS:
                cost += 0.6 * inside if c not in _SIGNS_IN_WORDS and c not in "²³°" else 0.0
                if c in "‘’“”«»–—…" and inside == 2 and c not in "’–‘":
                    cost += 0.6
            else:
                cost += 1.0 + 0.6 * inside
    if "?" in word:
        cost += 2.0 * len(_LOST_LETTER.findall(word)) * _may_have_lost(word)
    return cost


def cost(text: str) -> float:
    return sum(map(word_cost, re.split(r"([ \t\r\n]+)", text)[::2]))


_RUN = re.compile(r"[^\x00-\x7f]+(?: (?=[^\x00-\x7f]))?[^\x00-\x7f]*")


def _expected(c: str) -> bool:
    """Latin letters with the Vietnamese ones, Greek, signs, kana and ideographs."""
    return c < "ƀ" or c in "ƠơƯưƒˆ˜" or "Ͱ" <= c <= "Ͽ" or "Ḁ" <= c <= "ỿ" or "\u2000" <= c <= "⋿" or "─" <= c <= "◿" or "\u3000" <= c <= "ヿ" or "一" <= c <= "鿿" or "＀" <= c <= "￯" or c == "\ufeff"


def _utf8_run(run: str, wrong: str) -> str:
    """The valid UTF-8 sequences of a run decoded, the rest as it is."""
    back = _charmap(wrong)[0]
    raw = [back.get(c, -1) for c in run]
    out, i = [], 0
    while i < len(raw):
        b = raw[i]
        n = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if n and i + n <= len(raw) and all(0x80 <= x <= 0xBF for x in raw[i + 1 : i + n]):
            try:
                c = bytes(raw[i : i + n]).decode("utf-8")
                if _expected(c):
                    out.append(c)
                    i += n
                    continue
            except UnicodeDecodeError:
                pass
        out.append(run[i])
        i += 1
    return "".join(out)


def _repair_utf8(text: str, wrong: str) -> str:
    done = re.sub(r"[^\x00-\x7f]+", lambda m: _utf8_run(m.group(), wrong), text)
    # a no-break space that was turned into a space was the last byte of à or of a capital
    if wrong in ("cp1252", "latin_1"):
        done = re.sub(r"Ã (?=[^\W\d_]|\s|$)|Ã$", lambda m: "à" if m.group() != "Ã" else "Ã", done)
    return done


def _repair_stretch(text: str, step) -> str:
    """Decode the stretch of words with the greatest drop in cost."""
    parts = re.split(r"([ \t\r\n]+)", text)
    words = parts[::2]
    new = [w if w.isascii() else step(w) for w in words]
    drops = [0.0 if n == w else word_cost(w) - word_cost(n) if n is not None else -3.0 for w, n in zip(words, new, strict=True)]
    if all(d >= 0 for d in drops) and all(n is not None for n in new):
        low, high = 0, len(words)
    else:
        best, low, high, total, start = 0.0, 0, 0, 0.0, 0
        for i, d in enumerate(drops):
            total += d
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, low, high = total, start, i + 1
    if sum(drops[low:high]) <= 0:
        return text
    parts[2 * low : 2 * high : 2] = [n if n is not None else w for n, w in zip(new[low:high], words[low:high], strict=True)]
    return "".join(parts)


def _repair_whole(text: str, wrong: str, right: str) -> str:
    """Strict decoding of the whole text, or of one line of it."""
    lines = []
    for line in re.split(r"(\r\n|\n)", text):
        raw = _to_bytes(line, wrong) if not line.isascii() else None
        if raw is not None:
            try:
                line = raw.decode(right)
            except UnicodeDecodeError:
                pass
        lines.append(line)
    return "".join(lines)


def _whole(text: str, wrong: str, right: str) -> str:
    """A single-byte pair over the whole text; one word that cannot be read leaves it as it is."""
    parts = re.split(r"([ \t\r\n]+)", text)
    new = [w if w.isascii() else _pair(wrong, right, w) for w in parts[::2]]
    if any(w is None for w in new):
        return text
    parts[::2] = new
    return "".join(parts)


def _mostly_cjk(text: str) -> bool:
    letters = [c for c in text if c.isalpha()]
    return len(letters) > 1 and sum(c >= "\u3040" for c in letters) >= 0.8 * len(letters)


def _families(text: str):
    """Candidate steps in order of certainty: (least drop, most of the cost that may stay, steps).

    A later family is tried where no earlier one helps.
    """
    utf8 = [(f"utf-8 as {w}", lambda t, w=w: _repair_utf8(t, w)) for w in WRONG]
    yield 0.5, 0.5, utf8
    if not any("Ạ" <= c <= "ỹ" for c in text):
        yield LEAST_DROP, 0.3, [(f"{r} as {w}", lambda t, w=w, r=r: _repair_whole(t, w, r)) for r in CJK for w in ("cp1252", "latin_1", "mac_roman", "cp437", "cp1251", "cp1258")]
    legacy = [("tcvn3 as cp1252", lambda t: _repair_stretch(t, _from_tcvn3)), ("vni as cp1252", lambda t: _repair_stretch(t, _from_vni)), ("cp1258 as cp1252", lambda t: _repair_stretch(t, functools.partial(_pair, "cp1252", "cp1258")))]
    yield LEAST_DROP, 0.9, legacy + [(f"{r} as {w}", lambda t, w=w, r=r: _whole(t, w, r)) for w, r in PAIRS]
    yield 0.5, 1.0, utf8


_VIETNAMESE_PAGES = ("tcvn3", "vni", "cp1258")


def _reads_well(text: str, new: str, label: str) -> bool:
    """Whether the words that a single-byte reading changes become plain ones, Vietnamese ones for a Vietnamese page."""
    changed = [b for a, b in zip(text.split(), new.split()) if a != b]
    if not changed or sum(map(word_cost, changed)) > 0.5 * len(changed):
        return False
    if label.startswith(_VIETNAMESE_PAGES):
        own = [m.group() for w in changed for m in _WORD.finditer(unicodedata.normalize("NFC", w)) if not m.group().isascii()]
        return 2 * sum(map(is_vietnamese_syllable, own)) >= max(1, len(own)) and not any(map(unicodedata.combining, unicodedata.normalize("NFC", new)))
    return True


def _all_vietnamese(text: str) -> bool:
    return all(m.group().isascii() and len(m.group()) == 1 or is_vietnamese_syllable(m.group()) for m in _WORD.finditer(text))


def _gone(text: str) -> bool:
    """Whether characters are lost beyond repair."""
    return "�" in text or _lost_letters(text) or any("\x80" <= c < "\xa0" for c in text)


_LEFTOVER = re.compile("[ÃÂÄÅÆ][\x80-\xbf–—‘’“”„†‡•…‰‹›€™œŒžŽŸšŠƒˆ˜]|á[º»][\x80-\xbf–—‘’“”„†‡•…‰‹›€™œŒžŽŸšŠƒˆ˜]?|[├┬─╗║ß╞][^\x00-\x7f]|\x9d")


@functools.lru_cache(1 << 16)
def repair(text: str) -> tuple[str, str | None, str | None]:
    """(status, restored text, the layers) of one text; status '' where it is clean."""
    before = cost(text)
    if before < 0.5:
        return ("lost" if _lost_letters(text) else ""), None, None
    now, layers = text, []
    while len(layers) < MAX_LAYERS and before >= 0.3:
        for least, stays, steps in _families(now):
            tried = [(cost(new), label, new) for label, step in steps if (new := step(now)) != now]
            if steps[0][0].startswith("utf-8"):  # of a nested text the first layer shows in the second
                again = dict(steps)
                tried = [(min(c, cost(again[label](new))), c, label, new) for c, label, new in tried]
                tried = [(c, label, new) for after, c, label, new in sorted(tried)[:1] if after <= stays * before]
            # a reading without letters is none, nor is one that leaves the words it changes as odd as they were
            tried = [x for x in tried if any(map(str.isalpha, x[2]))]
            if steps[0][0].startswith("tcvn3"):
                tried = [x for x in tried if _reads_well(now, x[2], x[1])]
            if steps[0][0].startswith(CJK):
                tried = [x for x in tried if _mostly_cjk(x[2])]
            best = min(tried, default=None)
            if best is not None and least > 0.5 and 0.5 <= before - best[0] < least and _all_vietnamese(best[2]):
                least = 0.5  # little evidence, but every word of the text becomes a syllable
            if best is not None and before - best[0] >= least and (steps[0][0].startswith("utf-8") or best[0] <= stays * before):
                before, label, now = best
                layers.append(label)
                break
        else:
            break
    if layers:
        return ("partial" if _gone(now) or _LEFTOVER.search(now) else "restored"), now, " / ".join(layers)
    if "�" in text or _lost_letters(text) or _LEFTOVER.search(text) or any("\x80" <= c < "\xa0" for c in text):
        return "lost", None, None
    return "", None, None


REPAIR_TYPE = T.StructType([T.StructField(c, T.StringType()) for c in ("status", "restored", "layers")])


def _repair_values(text: pd.Series) -> pd.DataFrame:
    codes, values = pd.factorize(text)
    done = pd.DataFrame([repair(v) for v in values] + [("", None, None)], columns=["status", "restored", "layers"])
    return done.iloc[codes].reset_index(drop=True)


# else the optimizer copies it into the filter on its status and runs it twice
repair_column = F.pandas_udf(_repair_values, REPAIR_TYPE).asNondeterministic()


def garbled_texts(table: DataFrame, text: str = "source_text") -> DataFrame:
    """Rows whose ``text`` was decoded wrongly, with encoding_repair: status, restored, layers.

    Text that is ASCII without a question mark cannot be garbled and does not enter Python.
    """
    return table.where(F.col(text).rlike(r"[^\x00-\x7F]|\?")).withColumn("encoding_repair", repair_column(F.col(text))).where("encoding_repair.status <> ''")
