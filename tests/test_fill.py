"""Budgeted fills over more items than come to the driver at a time."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomsift.operators import ranking, selection


def slow_fill(items, key, budget):
    taken = set()
    for i in sorted(items, key=key):
        if i[1] <= budget:
            taken.add(i[0])
            budget -= i[1]
    return taken


@pytest.mark.parametrize("budget", [0, 40, 5_000, 170_000, 10**9])
def test_utility_fill_of_many_items(spark, budget):
    items = [(i, i * 7919 % 30 + (i % 40 > 0), i % 11 / 4) for i in range(23_000)]
    df = spark.range(23_000).select("id", (F.col("id") * 7919 % 30 + (F.col("id") % 40 > 0).cast("bigint")).alias("tokens"), (F.col("id") % 11 / 4).alias("utility"))
    got = [r.id for r in selection.utility_fill(df, budget).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_fill(items, lambda x: (-x[2], x[0]), budget)


@pytest.mark.parametrize("block", [1, 3, 50])
@pytest.mark.parametrize("budget", [100, 2_000])
def test_blocks_of_any_size(spark, block, budget):
    rnd = random.Random(block)
    items = [(f"n{i:03}", rnd.choice([0, 1, 5, 30, 300]), rnd.choice([None, "a", "b"])) for i in range(90)]
    df = spark.createDataFrame(items, "id string, tokens bigint, k string")
    got = {r.id for r in ranking.static_fill(df, [F.col("k")], budget, block).collect()}
    assert got == slow_fill(items, lambda x: (x[2] or "", x[0]), budget)


def test_items_without_utility_come_last(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 5, 0.5), (3, 5, 2.0)], "id bigint, tokens bigint, utility double")
    assert {r.id for r in selection.utility_fill(df, 10).collect()} == {2, 3}


def slow_cover(items, budget, needs):
    """Ids by plain loops; items are (id, tokens, attribute)."""
    items = sorted(items, key=lambda x: hashlib.sha256(f"select:{x[0]}".encode()).hexdigest())
    taken = []
    for value, least in [*sorted(needs.items()), (None, len(items))]:
        here = 0
        for x in items:
            if x not in taken and value in (None, x[2]) and x[1] <= budget and here < least:
                taken.append(x)
                budget -= x[1]
                here += 1
        assert value is None or here == least
    return {x[0] for x in taken}


@pytest.mark.parametrize("budget", [300, 900])
def test_covered_fill_of_many_items(spark, budget):
    items = [(i, i * 7919 % 60 + 1, "de" if i % 7 == 0 else "fr" if i % 7 == 1 else None) for i in range(24_000)]
    df = spark.range(24_000).select("id", (F.col("id") * 7919 % 60 + 1).alias("tokens"), F.when(F.col("id") % 7 == 0, "de").when(F.col("id") % 7 == 1, "fr").alias("lang"))
    got = [r.id for r in selection.covered_fill(df, budget, "lang", {"de": 4, "fr": 3}).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_cover(items, budget, {"de": 4, "fr": 3})


@pytest.mark.parametrize("needs", [{"de": 6}, {"de": 40, "en": 45}, {"en": 0}, {}])
def test_covered_fill_passes_over_items_that_do_not_fit(spark, monkeypatch, needs):
    monkeypatch.setattr(ranking.fill, "__defaults__", (16, None))
    items = [(i, 5_000 if i % 3 == 0 else i % 4, "de" if i % 2 else "en") for i in range(160)]
    got = [r.id for r in selection.covered_fill(spark.createDataFrame(items, "id bigint, tokens bigint, lang string"), 400, "lang", needs).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_cover(items, 400, needs)


def test_too_few_that_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, 5, "de"), (2, 500, "de"), (3, 5, "en")], "id bigint, tokens bigint, lang string")
    with pytest.raises(ValueError):
        selection.covered_fill(df, 100, "lang", {"de": 2})


@pytest.mark.parametrize("budget", [30, 2_000, 400_000])
def test_random_fill_of_many_items(spark, budget):
    items = [(i - 9_000, i * 7919 % 50) for i in range(26_000)]
    df = spark.range(26_000).select((F.col("id") - 9_000).alias("id"), (F.col("id") * 7919 % 50).alias("tokens"))
    got = [r.id for r in selection.random_fill(df, budget, "s").collect()]
    assert len(got) == len(set(got)) and set(got) == slow_fill(items, lambda x: hashlib.sha256(f"s:{x[0]}".encode()).hexdigest(), budget)
