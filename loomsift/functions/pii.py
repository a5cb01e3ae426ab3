"""Personal data in text: e-mail addresses, phone numbers and payment cards.

A value is found at its place and replaced there, never by its text elsewhere; where two kinds
overlap, the one that begins first stands. Word boundaries and digits are those of all scripts.
A null text holds nothing; an empty or very long one is scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsift.functions import spans
from loomsift.functions.spans import Span

# The patterns and reserved names that decide what counts.
EMAIL = r"\b[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})\b"
PHONE_US = r"(?<!\w)\(?([2-9]\d{2})\)?[ .-]([2-9]\d{2})[ .-](\d{4})(?!\w)"
PHONE_INTL = r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){1,5}(?!\w)"
CARD = r"(?<!\w)(?:\d[ -]?){12,18}\d(?!\w)"
RESERVED = r"(?:^|\.)example\.(?:com|org|net)$|\.(?:example|test|invalid|localhost|local)$"
EXCHANGE_555 = "555"
PHONE_KEY = r"phone|mobile|cell|tel(?:ephone)?\b|fax|whatsapp|contact|msisdn"
CARD_KEY = r"card|\bcc|ccn|\bpan\b|credit"
GIT_REMOTE = r"[\w.-]+@[\w.-]+:[\w./~-]+"
MAIL, PHONE, PAYMENT = "email address", "phone number", "payment card number"
PLACEHOLDERS = {MAIL: "[REDACTED_EMAIL]", PHONE: "[REDACTED_PHONE]", PAYMENT: "[REDACTED_CARD]"}

_EMAIL, _US, _INTL, _CARD = map(re.compile, (EMAIL, PHONE_US, PHONE_INTL, CARD))
_RESERVED, _REMOTE = re.compile(RESERVED), re.compile(GIT_REMOTE)
_PHONE_KEY, _CARD_KEY = re.compile(PHONE_KEY, re.I), re.compile(CARD_KEY, re.I)
_SIGNED_DECIMAL = re.compile(r"\+\d+\.\d+")
_OPERATOR = re.compile(r"\s*(?:[=<>*/]|[+-]\s*\d)")
#: Texts without eight digits close together hold no number to look at; Java and RE2 read it as well.
DIGITS = r"\p{Nd}[\p{Nd}() .-]{5,}\p{Nd}"
_SEVERAL_DIGITS = re.compile(r"\d[\d() .-]{5,}\d")


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


def luhn(digits: str) -> bool:
    """Whether the check digit of a number is right."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _operand(text: str, start: int, end: int) -> bool:
    """Whether a signed number stands inside a sum or a comparison."""
    while start and text[start - 1].isspace():
        start -= 1
    return start > 0 and (text[start - 1].isdecimal() or text[start - 1] == ")") and bool(_OPERATOR.match(text, end))


def _international(text: str, m: re.Match[str]) -> bool:
    if _SIGNED_DECIMAL.fullmatch(m.group()) or _operand(text, *m.span()):
        return False
    number = _digits(m.group())
    return 8 <= len(number) <= 15 and not (len(number) == 11 and number[0] == "1" and number[4:7] == EXCHANGE_555)


def _payment(m: re.Match[str]) -> bool:
    number = _digits(m.group())
    return 13 <= len(number) <= 19 and number[0] in "3456" and len(set(number)) > 2 and luhn(number)


def find(text: str) -> list[Span]:
    """The personal data of a text, none overlapping another."""
    found: list[Span] = []
    if "@" in text:
        found += (Span(*m.span(), MAIL) for m in _EMAIL.finditer(text) if not _RESERVED.search(m.group(1).lower()))
    if _SEVERAL_DIGITS.search(text):
        found += (Span(*m.span(), PHONE) for m in _INTL.finditer(text) if _international(text, m))
        found += (Span(*m.span(), PHONE) for m in _US.finditer(text) if m.group(2) != EXCHANGE_555)
        found += (Span(*m.span(), PAYMENT) for m in _CARD.finditer(text) if _payment(m))
    return spans.disjoint(found)


def find_in_field(key: str, text: str) -> list[Span]:
    """What counts in a string outside the training text: addresses, and numbers where the key says what they are."""
    if _REMOTE.fullmatch(text.strip()):
        return []
    kinds = {MAIL} | ({PHONE} if _PHONE_KEY.search(key) else set()) | ({PAYMENT} if _CARD_KEY.search(key) else set())
    return [s for s in find(text) if s.kind in kinds]


def redact(text: str) -> str:
    return spans.replaced(text, find(text), PLACEHOLDERS.__getitem__)


def redact_field(key: str, text: str) -> str:
    return spans.replaced(text, find_in_field(key, text), PLACEHOLDERS.__getitem__)


def mask(kind: str, value: str) -> str:
    """The first letter and top-level domain of an address, the last four digits of a number."""
    return f"{value[:1]}***@***.{value.rpartition('.')[2]}" if kind == MAIL else f"…{_digits(value)[-4:]}"


def hint(text: Column) -> Column:
    """Texts that may hold personal data."""
    return F.contains(text, F.lit("@")) | text.rlike(DIGITS)


def found(text: Column) -> Column:
    """array<struct<kind,value>> of the personal data in a text, null without any."""
    return spans.found_in(text, hint(text), find)


def redacted(text: Column) -> Column:
    """The text with typed placeholders."""
    return spans.changed_by(text, hint(text), redact)


def masked(kind: Column, value: Column) -> Column:
    """What a report may show of a value."""
    mail = F.concat(F.substring(value, 1, 1), F.lit("***@***."), F.element_at(F.split(value, "\\."), -1))
    return F.when(kind == MAIL, mail).otherwise(F.concat(F.lit("…"), F.right(F.regexp_replace(value, "[^\\p{Nd}]", ""), F.lit(4))))
