"""Spans found in texts: resolving overlaps, replacing by place, and running finders in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def disjoint(found: Iterable[Span]) -> list[Span]:
    """The spans in order of their start, the longest first among equals, without those that begin inside one before."""
    kept: list[Span] = []
    for s in sorted(found, key=lambda x: (x.start, -x.end)):
        if not kept or s.start >= kept[-1].end:
            kept.append(s)
    return kept


def replaced(text: str, found: list[Span], placeholder: Callable[[str], str]) -> str:
    """The text with each of the disjoint, ordered spans replaced where it stands."""
    parts, at = [], 0
    for s in found:
        parts += (text[at : s.start], placeholder(s.kind))
        at = s.end
    return "".join(parts) + text[at:]


def found_in(text: Column, hint: Column, find: Callable[[str], list[Span]]) -> Column:
    """array<struct<kind,value>> of the spans of a text column, null without any; only texts with the hint reach Python."""

    @F.pandas_udf("array<struct<kind:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        each = lambda t: [{"kind": s.kind, "value": t[s.start : s.end]} for s in find(t)] or None if t else None
        return pd.Series([each(t) for t in texts], dtype=object)

    return run(F.when(hint, text))


def changed_by(text: Column, hint: Column, change: Callable[[str], str]) -> Column:
    """The text column changed in Python where it has the hint, else as it is."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([change(t) if t else t for t in texts], dtype=object)

    return F.coalesce(run(F.when(hint, text)), text)
