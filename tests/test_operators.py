"""Ranks, splits, selection, scores and statistics against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomsift.operators import ranking, selection, splits, stats

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def test_hashed_rank_with_a_hot_and_a_null_key(spark):
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else "cold") for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, key string").withColumn("digest", ranking.seeded("s", "id")).withColumn("n", F.lit(1))
    got = {r.id: r["rank"] for r in ranking.hashed_rank(df, ["key"], "digest").collect()}
    for key in (None, "hot", "cold"):
        own = sorted((i for i, k in rows if k == key), key=lambda i: sha(f"s:{i}"))
        assert [got[i] for i in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("budget", [0, 50, 3000, 10**9])
def test_static_fill(spark, budget):
    rnd = random.Random(budget)
    items = [(i, rnd.randrange(1, 400)) for i in range(120)] + [(500, None)]
    got = {r.id for r in selection.random_fill(spark.createDataFrame(items, "id bigint, tokens bigint"), budget).collect()}
    left, expected = budget, set()
    for i, n in sorted((x for x in items if x[1] is not None), key=lambda x: sha(f"select:{x[0]}")):
        if n <= left:
            expected.add(i)
            left -= n
    assert got == expected


def test_covered_fill(spark):
    items = spark.createDataFrame([(i, 10, "de" if i % 10 == 0 else "en") for i in range(60)], "id bigint, tokens bigint, lang string")
    got = selection.covered_fill(items, 100, "lang", {"de": 4}).collect()
    assert sum(r.tokens for r in got) == 100 and sum(r.id % 10 == 0 for r in got) >= 4
    with pytest.raises(ValueError):
        selection.covered_fill(items, 30, "lang", {"de": 4})


def test_split_halves_and_prompt_split(spark):
    df = spark.createDataFrame([(i, "a" if i < 9 else "b") for i in range(10)], "id bigint, cap string")
    half = {r.id: r.half for r in splits.split_halves(df, "cap", "id").collect()}
    assert sum(h == "selection" for h in half.values()) == 4 and half[9] is None
    rows = spark.createDataFrame([(i, "ab"[i % 2], f"prompt {i % 9}") for i in range(60)], "id bigint, cat string, prompt string")
    parts = splits.split_by_prompt(rows, "cat", "prompt", "id", 1, 1).collect()
    prompts = {p: {f"prompt {r.id % 9}" for r in parts if r.part == p} for p in ("train", "dev", "test")}
    assert not prompts["train"] & (prompts["dev"] | prompts["test"])
    assert splits.capped(rows, "cat", "id", 10).count() == 10


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(4)
    base = [[rnd.choice("abcdefgh") + str(rnd.randrange(4)) for _ in range(rnd.randrange(3, 40))] for _ in range(8)]
    rows = []
    for i in range(90):
        words = list(rnd.choice(base))
        if rnd.random() < 0.6:
            words[rnd.randrange(len(words))] = "zz"
        rows.append((i, " ".join(words) if i else None))
    df = spark.createDataFrame(rows, "k bigint, t string")
    left, right = df.where("k % 3 <> 0"), df.where("k % 3 = 0")
    got = {(r.left_key, r.right_key): r.similarity for r in splits.near_duplicates(left, right, "k", "t").collect()}

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    def firsts(side):
        out = {}
        for k, t in rows:
            if t is not None and (k % 3 != 0) == side:
                out.setdefault(t, k)
        return out

    expected = {}
    for a, i in firsts(True).items():
        for b, j in firsts(False).items():
            x, y = grams(a), grams(b)
            if len(x & y) / len(x | y) >= 0.8:
                expected[i, j] = len(x & y) / len(x | y)
    assert got == pytest.approx(expected) and expected
    kinds = {r.kind for r in splits.leakage(left, right, "k", "t").collect()}
    assert "exact" in kinds


def test_orders_and_scores(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1.0), (2, [0.9, 0.1], 0.9), (3, [0.0, 1.0], 0.5), (4, [0.0, 0.0], 0.1)], "id bigint, v array<double>, u double")
    assert selection.k_center(v, "id", "v", 2)[1] in (3, 4)
    assert selection.marginal_relevance(v, "id", "v", "u", 3, 0.9)[:2] == [1, 3]
    scores = selection.alignment(v.select("id", "v"), "id", "v", {"x": [1, 0], "y": [0, 1]})
    c = {r.id: (round(r.target, 6), round(r.retention, 6)) for r in selection.combined(scores, "id", ["x"], ["y"]).collect()}
    assert c[1] == (1.0, 0.0) and c[3] == (0.0, 1.0) and c[4] == (0.0, 0.0)
    assert selection.checkpoint_weights({1: 0.0, 2: 0.0}) == {1: 0.5, 2: 0.5}
    f = spark.createDataFrame([("abcab",), ("",)], "t string").select(selection.text_features(F.col("t")).alias("f")).collect()
    assert math.isclose(sum(x * x for x in f[0].f), 1.0) and len(f[0].f) == 256


def test_statistics(spark):
    rnd = random.Random(1)
    rows = [(arm, seed, base + rnd.random()) for arm, base in (("base", 0.0), ("up", 5.0), ("same", 0.0)) for seed in range(4) for _ in range(6)]
    spread = stats.across_seeds(spark.createDataFrame(rows, "arm string, seed int, x double"), ["arm"], "seed", "x")
    got = {r.arm: r for r in spread.collect()}
    means = [statistics.mean(x for a, s, x in rows if a == "up" and s == k) for k in range(4)]
    assert got["up"].mean == pytest.approx(statistics.mean(means)) and got["up"].std == pytest.approx(statistics.stdev(means))
    verdicts = {r.arm: r.verdict for r in stats.welch(spread, "arm", "base").collect()}
    assert verdicts == {"up": "supported", "same": "insufficient_evidence"}
    assert {r.verdict for r in stats.welch(spread, "arm", "up").where("arm = 'base'").collect()} == {"contradicted"}
    ci = stats.bootstrap(spark.createDataFrame([(float(i),) for i in range(100)], "x double"), "x").first()
    assert ci.low < 49.5 < ci.high and ci.high - ci.low < 25
    t = spark.createDataFrame([(0.5,), (1.0,), (30.9,), (35.0,), (500.0,)], "d double").select(stats.t95(F.col("d")).alias("t"))
    assert [r.t for r in t.collect()] == [math.inf, 12.706, 2.042, 2.042, 1.98]
