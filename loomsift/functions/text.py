"""Text expressions: stripping, token estimates, repair of garbled sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip() sees it, as a character class that Java and RE2 both read. Fixed values.
WHITE = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP_PATTERN = f"^{WHITE}+|{WHITE}+$"
WHITE_CHARACTERS = "".join(chr(n) for n in range(0x3001) if chr(n).isspace())
BOM = "﻿"
#: Garbled sequences and what they stood for, in the order of repair. Fixed values.
GARBLED = (
    ("â€™", "’"), ("â€œ", "“"), ("â€\x9d", "”"), ("â€“", "–"), ("â€”", "—"), ("â€¦", "…"), ("Ã©", "é"),
    ("Ã¨", "è"), ("Ã¢", "â"), ("Ã®", "î"), ("Ã¯", "ï"), ("Ã´", "ô"), ("Ã»", "û"), ("Â ", "\xa0"),
)
MESSAGE_OVERHEAD = 4


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space at either end, whatever the script of the blanks."""
    return F.trim(text, F.lit(WHITE_CHARACTERS))


def approximate_tokens(text: Column) -> Column:
    """A quarter of the code points, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def message_tokens(role: Column, content: Column) -> Column:
    """Estimated tokens of a message with its role tag and overhead; a text that is missing counts as empty."""
    return approximate_tokens(F.concat(F.lit("<"), F.coalesce(role, F.lit("")), F.lit(">\n"), F.coalesce(content, F.lit("")))) + MESSAGE_OVERHEAD


def garbled_marker(text: Column) -> Column:
    """The number of the first garbled sequence the text holds, by order of repair; null without one."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(bad)), F.lit(n)) for n, (bad, _) in enumerate(GARBLED)))


def repaired(text: Column) -> Column:
    """The text without byte order marks, its garbled sequences replaced in order."""
    out = F.replace(text, F.lit(BOM), F.lit(""))
    for bad, good in GARBLED:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def repaired_text(text: str) -> str:
    """The same for one text in Python."""
    text = text.replace(BOM, "")
    for bad, good in GARBLED:
        text = text.replace(bad, good)
    return text


def words(text: Column) -> Column:
    """Words between blanks, lower case."""
    return F.filter(F.split(F.lower(text), f"{WHITE}+"), lambda w: w != "")
