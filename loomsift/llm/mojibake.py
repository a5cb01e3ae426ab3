"""Text decoded with a wrong character encoding (problem 5).

Runs of characters are mapped back to the bytes of a legacy encoding; an automaton over
the structure of UTF-8 finds the maximal well-formed multibyte spans, and only those
spans are decoded. A span counts when what it decodes to is plausible and its own
characters are not: an upper-case Ã before a blank, or É before a closing quote, is
ordinary text. Text that lost characters (U+FFFD, a lone Ã, an â where an apostrophe
stood) is a case that cannot be restored; its spans that can be are.

Null and empty texts are no cases. Texts of any length are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Legacy encodings tried, in this order. Fixed values, as Python names them.
ENCODINGS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_15")
#: Multibyte legacy encodings in which whole runs are tried. Fixed values.
WIDE_ENCODINGS = ("gb18030", "big5", "shift_jis", "euc_kr")

_RUN = re.compile(r"[^\x00-\x7f]{2,}")
_HAN_RUN = re.compile(r"[㐀-鿿가-힣｡-ﾟ-]{2,}")
_SUSPECT = re.compile(r"[^\x00-\x7f]{2}|[\x80-\x9fÃÂâ�]")
_CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")
#: Characters that stand beside letters in ordinary text: blanks, quotes, dashes, dots.
_ORDINARY = frozenset(" «»“”‘’‚„‹›–—…·•°™®©´`")
_UPPER_HALF = re.compile(r"(?<![^\W\d_])[À-ÖØ-öø-ÿ]{3,}(?![^\W\d_])")
_LOST = re.compile(
    r"�"
    r"|(?<![^\W\d_])Ã(?![^\W\d_])|(?<![^\W\d_])Â(?![^\W\d_])"
    r"|[A-Za-z]â(?:s|t|re|ve|ll|d|m)(?![^\W\d_])"
    r"|(?<![^\W\d_])(?:[ldjmtsncLDJMTSNC]|[Qq]u)â(?=[aeiouyhéèêœ])"
    r"|(?<![^\W\d_])â(?=\s)|(?<![^\W\d_])â[^\W\d_]+â"
    r"|[a-zà-ÿ]Ã[a-zà-ÿ]"
)


@cache
def _byte_map(encoding: str) -> dict[str, int]:
    """Characters of the encoding's upper half; control characters stand for themselves where a byte has no character."""
    table = {}
    for n in range(128, 256):
        try:
            table[bytes([n]).decode(encoding)] = n
        except UnicodeDecodeError:
            pass
        table.setdefault(chr(n), n) if n < 160 else None
    return table


def _plausible(c: str) -> bool:
    n = ord(c)
    return (
        0xA0 <= n <= 0x17F  # Latin
        or 0x370 <= n <= 0x3FF or 0x400 <= n <= 0x45F or n in (0x490, 0x491)  # Greek, Cyrillic
        or 0x5D0 <= n <= 0x5EA or 0x620 <= n <= 0x652 or 0x900 <= n <= 0x97F or 0xE00 <= n <= 0xE5B  # Hebrew, Arabic, Devanagari, Thai
        or 0x1E00 <= n <= 0x1EFF or n in (0x192, 0x2C6, 0x2DC)
        or 0x2010 <= n <= 0x2044 or 0x20A0 <= n <= 0x20BF or 0x2100 <= n <= 0x22FF or n in (0x200B, 0xFEFF, 0x2002, 0x2003, 0x2009)
        or 0x2500 <= n <= 0x27BF
        or 0x3000 <= n <= 0x30FF or 0x3400 <= n <= 0x9FFF or 0xAC00 <= n <= 0xD7A3 or 0xFF00 <= n <= 0xFF65
        or 0x1F300 <= n <= 0x1FAFF
    )


def _spans(codes: list[int]) -> Iterator[tuple[int, int, list[str]]]:
    """Maximal well-formed multibyte spans of a byte string, -1 marking no byte: (start, end, characters)."""
    at, n = 0, len(codes)
    start, chars = 0, []
    while at < n:
        b = codes[at]
        need = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
        ok = need and at + need < n and all(0x80 <= x <= 0xBF for x in codes[at + 1 : at + 1 + need])
        if ok:
            try:
                c = bytes(codes[at : at + 1 + need]).decode()
            except UnicodeDecodeError:
                ok = False
        if ok:
            if not chars:
                start = at
            chars.append(c)
            at += 1 + need
            continue
        if chars:
            yield start, at, chars
            chars = []
        at += 1
    if chars:
        yield start, at, chars


@cache
def _automaton(encoding: str) -> re.Pattern[str]:
    """One well-formed multibyte character, in the characters of the encoding."""
    by_byte: dict[int, str] = {}
    for c, n in _byte_map(encoding).items():
        by_byte[n] = by_byte.get(n, "") + re.escape(c)

    def among(low: int, high: int) -> str:
        return "[" + "".join(by_byte.get(n, "") for n in range(low, high + 1)) + "]"

    tail = among(0x80, 0xBF)
    return re.compile(f"{among(0xC2, 0xDF)}{tail}|{among(0xE0, 0xEF)}{tail}{{2}}|{among(0xF0, 0xF4)}{tail}{{3}}")


@cache
def _any_automaton() -> re.Pattern[str]:
    return re.compile("|".join(_automaton(e).pattern for e in ENCODINGS))


def _cyrillic(c: str) -> bool:
    return "Ѐ" <= c <= "џ"


def _accept(encoding: str, source: str, chars: list[str], before: str, after: str) -> bool:
    """Whether a span is damage rather than ordinary text. before, after: the characters beside it."""
    if not all(map(_plausible, chars)) and not (len(chars) > 2 and all(_plausible(c) or "\x80" <= c <= "\x9f" for c in chars)):
        return False
    if "".join(chars) == source:
        return False
    if len(chars) > 1:
        if encoding in ("cp1251", "koi8_r", "cp866", "mac_roman", "cp437", "cp850"):
            return True
        # é + no-break blank + quote, twice in a row, is still ordinary
        return not all(x in _ORDINARY or x.isalpha() and x.lower() == x and x in "àâäçèéêëîïôöùûüñáíóúß" for x in source)
    c, tail = chars[0], source[1:]
    ordinary_tail = all(x in _ORDINARY for x in tail)
    if encoding in ("cp1251", "koi8_r", "cp866"):
        # one character alone: a Cyrillic letter before punctuation is ordinary unless Latin letters surround it
        if source[0].isalpha() and _cyrillic(source[0]) and (ordinary_tail or all(_cyrillic(x) for x in tail)):
            return False
        return not ordinary_tail and not (before.isalpha() and _cyrillic(before)) and (c.isalpha() or len(tail) > 1)
    if _cyrillic(c) or "Ͱ" <= c <= "Ͽ":
        return False
    if len(tail) >= 2:
        if encoding in ("cp1252", "iso8859_15", "cp1250") and ordinary_tail and source[0].islower() and source[0] != "â":
            return False
        return True
    if before.isupper() and not after.isalpha() and ordinary_tail:
        return False
    if source[0] in "ÃÂ":
        return not (source[0] == "Â" and before.isalpha() and ordinary_tail and not after.isalnum() and before.isupper())
    if encoding == "mac_roman":
        return source[0] in "√¬¬" and (source[0] == "√" or not tail.isspace())
    if encoding in ("cp437", "cp850"):
        return source[0] in "├┬" and not (tail in "─│┌┐└┘├┤┬┴┼" and not (before.isalnum() or after.isalnum()))
    if "Ā" <= c <= "ſ":
        inside = before.isalpha() or after.isalpha()
        return inside and not (tail in "”»’…" and not after.isalpha()) and (source[0] in "ÅÄĹÄĂ")
    return not ordinary_tail or (before.islower() and after.isalpha())


def _narrow(text: str) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    shape = _any_automaton()
    if not shape.search(text):
        return found
    single: list[tuple[int, int, str]] = []
    for run in _RUN.finditer(text):
        s, e = run.span()
        piece = run.group()
        if not shape.search(piece):
            continue
        best: list[tuple[int, int, str]] = []
        for encoding in ENCODINGS:
            table = _byte_map(encoding)
            codes = [table.get(x, -1) for x in piece]
            if sum(x < 0 for x in codes) == len(codes):
                continue
            mine = []
            for a, b, chars in _spans(codes):
                before = text[s + a - 1] if s + a else " "
                after = text[s + b] if s + b < len(text) else " "
                if _accept(encoding, piece[a:b], chars, before, after):
                    mine.append((s + a, s + b, "".join(chars)))
                elif encoding == "cp1251" and len(chars) == 1 and b - a == len(piece) and _cyrillic(chars[0]):
                    single.append((s + a, s + b, chars[0]))
            if sum(b - a for a, b, _ in mine) > sum(b - a for a, b, _ in best):
                best = mine
        found += best
    if any(_cyrillic(plain[0]) for _, _, plain in found):  # beside other damage, a lone pair is damage too
        found = sorted({*found, *single})
    return found


def _wide(text: str) -> list[tuple[int, int, str]]:
    """Whole ideographic runs that are UTF-8 read as a multibyte legacy encoding."""
    found = []
    for run in _HAN_RUN.finditer(text):
        piece = run.group()
        for encoding in WIDE_ENCODINGS:
            try:
                plain = piece.encode(encoding).decode()
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if all(map(_plausible, plain)) and len(plain) < len(piece) * 2:
                found.append((*run.span(), plain))
                break
    return found


def _single(text: str) -> str:
    """Text of a single-byte encoding read as Latin-1: words of nothing but upper-half letters."""
    words = _UPPER_HALF.findall(text)
    if len(words) < 2 and not any(len(w) > 5 for w in words):
        return text
    best, score = text, 0.0
    for encoding in ("cp1251", "koi8_r", "cp1253", "iso8859_5"):
        plain = "".join(words).encode("latin-1").decode(encoding, "replace")
        lower = sum(c.islower() and not c.isascii() for c in plain) / len(plain)
        inner = sum(b.isupper() and a.islower() for a, b in zip(plain, plain[1:], strict=False)) / len(plain)
        if lower - inner > score:
            best, score = encoding, lower - inner
    if score < 0.6:
        return text
    decode = lambda m: m.group().encode("cp1252", "replace").decode(best, "replace")
    return re.sub(r"[À-ÿ÷×¸¨]+", decode, text)


_HALF_RUN = re.compile(r"[\x80-\xff]{6,}")
#: Two-byte encodings, the range of first bytes of their common characters, and the share of these in ordinary text. Fixed values.
_COMMON = (("gb2312", 0xB0, 0xD7, 0.75), ("euc_jp", 0xA4, 0xA5, 0.3), ("big5", 0xA4, 0xC6, 0.75), ("euc_kr", 0xB0, 0xC8, 0.75))


def _double(text: str) -> str:
    """Text of a two-byte encoding read as Latin-1: runs of upper-half characters that decode to common ideographs."""

    def decode(m: re.Match[str]) -> str:
        codes = m.group().encode("latin-1")
        try:
            codes.decode()
            return m.group()  # UTF-8 after all
        except UnicodeDecodeError:
            pass
        for encoding, low, high, share in _COMMON:
            for cut in (len(codes), len(codes) - 1):
                try:
                    plain = codes[:cut].decode(encoding)
                except UnicodeDecodeError:
                    continue
                if sum(low <= x <= high for x in codes[:cut:2]) >= share * cut / 2 and sum(c >= "⺀" for c in plain) >= 0.9 * len(plain):
                    return plain + m.group()[cut:]
        return m.group()

    return _HALF_RUN.sub(decode, text)


#: Share of each letter in Russian text, in per mille, а to я then ё. Fixed values.
_RUSSIAN = (80, 16, 45, 17, 30, 85, 9, 16, 74, 12, 35, 44, 32, 67, 110, 28, 47, 55, 63, 26, 3, 10, 5, 14, 7, 4, 1, 19, 17, 3, 6, 20, 1)
_WEIGHT = {c: math.log(n) for c, n in zip([*map(chr, range(0x430, 0x450)), "ё"], _RUSSIAN, strict=True)}
_CYRILLIC_WORD = re.compile(r"[Ѐ-џ]{2,}")


def _likeness(text: str) -> float:
    letters = [_WEIGHT[c] for c in text.lower() if c in _WEIGHT]
    return sum(letters) / len(letters) if letters else -9.0


def _cyrillic_swap(text: str) -> str:
    """Text of one Cyrillic single-byte encoding read as another: its letters are unlikely as they stand."""
    words = "".join(_CYRILLIC_WORD.findall(text))
    if len(words) < 12:
        return text
    own, best, plain = _likeness(words), 0.0, text
    if own > 3.4:
        return text
    for read, meant in (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251")):
        try:
            gain = _likeness(words.encode(read).decode(meant)) - own
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if gain > max(best, 0.4):
            best = gain
            plain = _CYRILLIC_WORD.sub(lambda m, r=read, t=meant: m.group().encode(r, "replace").decode(t, "replace"), re.sub(r"(?<![Ѐ-џ])[Ѐ-џ](?![Ѐ-џ])", lambda m, r=read, t=meant: m.group().encode(r, "replace").decode(t, "replace"), text))
    return plain


def repair(text: str, passes: int = 3) -> tuple[str, bool, bool]:
    """(restored text, whether any part was damaged, whether some damage remains)."""
    if text.isascii() or not _SUSPECT.search(text):
        return text, False, False
    damaged = False
    if (plain := _double(text)) != text:
        damaged, text = True, plain
    for _ in range(passes):
        spans = _narrow(text)
        if not spans:
            spans = _wide(text)
        if not spans:
            break
        damaged = True
        parts, at = [], 0
        for s, e, plain in spans:
            parts += [text[at:s], plain]
            at = e
        text = "".join(parts) + text[at:]
    if not damaged and (plain := _single(text)) != text:
        damaged, text = True, plain
    if (plain := _cyrillic_swap(text)) != text:
        damaged, text = True, plain
    if _CONTROL.search(text):  # single bytes of the encoding below, read as Latin-1
        damaged = True
        text = _CONTROL.sub(lambda m: m.group().encode("latin-1").decode("cp1252", "replace"), text)
    lost = bool(_LOST.search(text))
    return text, damaged or lost, lost


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fixed, damaged, lost = [], [], []
        for x in b.column(b.num_columns - 1).to_pylist():
            one = repair(x)
            fixed.append(one[0])
            damaged.append(one[1])
            lost.append(one[2])
        keys = [b.column(i) for i in range(b.num_columns - 1)]
        out = pa.RecordBatch.from_arrays([*keys, pa.array(fixed, pa.string()), pa.array(lost, pa.bool_())], ["table_name", "line_no", "turn", "restored", "incomplete"])
        yield out.filter(pa.array(damaged, pa.bool_()))


def damaged_texts(texts: DataFrame) -> DataFrame:
    """(table_name, line_no, turn, restored, incomplete) of the texts that are damaged in any part.

    ``texts`` has table_name, line_no, turn and text. Only texts with two adjoining
    characters beyond ASCII, or a mark of lost ones, are sent to Python.
    """
    some = texts.where(F.col("text").rlike("[^\\x00-\\x7F]{2}|[\\x80-\\x9FÃÂâ\\uFFFD]")).select("table_name", "line_no", "turn", "text")
    return some.mapInArrow(_scan, "table_name string, line_no bigint, turn bigint, restored string, incomplete boolean")
