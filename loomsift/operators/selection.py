"""Selection under a budget: orders, coverage, scores of alignment, distributions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.operators.ranking import chosen, fill, placed, seeded, static_fill

MOST_CAPABILITIES = 1000
#: Rows that the greedy diversity orders hold on the driver at a time; the table can be of any size.
MOST_SHORTLISTED = 20_000


def random_fill(items: DataFrame, budget: int, seed: str = "select") -> DataFrame:
    """Items in hashed order as long as they fit; ``items`` has id and tokens."""
    return static_fill(items, [seeded(seed, "id")], budget)


def utility_fill(items: DataFrame, budget: int) -> DataFrame:
    """Items by falling utility, those without one last, ties by id, as long as they fit."""
    return static_fill(items, [F.col("utility").isNull(), -F.col("utility")], budget)


def covered_fill(items: DataFrame, budget: int, attribute: str, needs: dict[str, int], seed: str = "select") -> DataFrame:
    """Items in hashed order that fit: first, for each value of the attribute, until its least number is met, then any.

    A value with too few items that fit is an error.
    """
    table = placed(items, [seeded(seed, "id")], attribute)
    left, parts, rest, singles = budget, [], table, []
    for value, least in sorted(needs.items()):
        own = table.where(F.col(attribute) == value)
        first = fill(own, left, most=least)
        if first.count < least:
            raise ValueError(f"the budget cannot cover {least} of {attribute} = {value}")
        left = first.left
        parts.append(chosen(own, first))
        singles += [(place,) for _, _, place in first.rows]
        rest = rest.where(~(F.col(attribute).eqNullSafe(F.lit(value)) & first.whole))
    if singles:
        rest = rest.join(F.broadcast(items.sparkSession.createDataFrame(singles, "place bigint")), "place", "left_anti")
    return reduce(DataFrame.unionByName, [*parts, chosen(rest, fill(rest, left))])


def shortlist(items: DataFrame, budget: int, factor: float = 4.0) -> DataFrame:
    """The items of highest utility, so many that their mean size fills ``factor`` budgets."""
    mean = items.agg(F.avg("tokens").alias("m")).first().m
    n = math.ceil(factor * budget / mean) if mean else 0
    return items.orderBy(F.desc("utility"), "id").limit(n)


def distribution(pool: DataFrame, chosen: DataFrame, attribute: str) -> DataFrame:
    """Records and tokens by value of an attribute, in the pool and in the selection, with shares rounded to 4."""
    marked = pool.join(chosen.select("id", F.lit(True).alias("picked")), "id", "left")
    value = F.coalesce(F.col(attribute), F.lit("(missing)")).alias("value")
    each = marked.groupBy(value).agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"), F.count("picked").alias("selected_records"), F.coalesce(F.sum(F.when(F.col("picked"), F.col("tokens"))), F.lit(0)).alias("selected_tokens"))
    total = each.agg(F.sum("tokens").alias("all"), F.sum("selected_tokens").alias("taken")).first()
    share = lambda c, n: F.round(F.col(c) / F.lit(max(n or 0, 1)), 4)
    return each.withColumns({"share": share("tokens", total["all"]), "selected_share": share("selected_tokens", total.taken)})


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_vectors(vectors: DataFrame, capability: str, vector: str) -> dict:
    """Mean vector of each capability; there are a few capabilities, more than ``MOST_CAPABILITIES`` are an error."""
    each = vectors.select(capability, F.posexplode(vector).alias("i", "x")).groupBy(capability, "i").agg(F.avg("x").alias("m"))
    rows = each.groupBy(capability).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v")).limit(MOST_CAPABILITIES + 1).collect()
    if len(rows) > MOST_CAPABILITIES:
        raise ValueError("too many capabilities")
    return {r[capability]: [float(x.m) for x in r.v] for r in rows}


def alignment(vectors: DataFrame, key: str, vector: str, targets: dict, checkpoint: str | None = None, weights: dict | None = None) -> DataFrame:
    """(key, capability, score): cosine of each vector with each capability's vector, weighted over checkpoints."""
    unit_rows = vectors.withColumn("u", unit(F.col(vector)))
    norm = lambda v: (np.array(v) / (np.linalg.norm(v) or 1.0)).tolist()
    parts = F.array(*(F.struct(F.lit(name).alias("capability"), dot(F.col("u"), F.array(*map(F.lit, norm(v)))).alias("score")) for name, v in sorted(targets.items())))
    each = unit_rows.select(key, *([checkpoint] if checkpoint else []), F.explode(parts).alias("s")).select(key, *([checkpoint] if checkpoint else []), "s.capability", "s.score")
    if not checkpoint:
        return each
    weight = F.create_map(*(F.lit(x) for kv in (weights or {}).items() for x in kv))[F.col(checkpoint)]
    return each.groupBy(key, "capability").agg(F.sum(F.col("score") * weight).alias("score"))


def checkpoint_weights(rates: dict) -> dict:
    """Learning rates as weights that sum to 1; equal weights where they sum to nothing."""
    total = sum(rates.values())
    return {k: v / total if total > 0 else 1 / len(rates) for k, v in rates.items()}


def combined(scores: DataFrame, key: str, target: list, retain: list, how: str = "max") -> DataFrame:
    """(key, target, retention): best or mean score over the target capabilities, worst over those to keep."""
    of = lambda names: F.when(F.col("capability").isin(list(names)), F.col("score"))
    best = F.max(of(target)) if how == "max" else F.avg(of(target))
    return scores.groupBy(key).agg(best.alias("target"), F.min(of(retain)).alias("retention"))


def available(scores: DataFrame, exclude_negative: bool = True, retention_floor: float | None = None) -> DataFrame:
    kept = scores.where("target > 0") if exclude_negative else scores
    return kept.where(F.col("retention") >= retention_floor) if retention_floor is not None else kept


def score_summary(scores: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return scores.agg(F.min(c).alias("least"), F.percentile(c, F.lit(0.5)).alias("middle"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.count_if(c < 0).alias("negative"))


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), float).reshape(len(vectors), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1)


def _along(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products of rows with one vector; unlike those of a matrix product, none depends on the other rows."""
    return (m * v).sum(axis=1)


def _nearest(m: np.ndarray, picks: list[np.ndarray]) -> np.ndarray:
    """Greatest likeness of each row to the picks; 0 without any."""
    return np.max([_along(m, p) for p in picks], axis=0) if picks else np.zeros(len(m))


def _best(rows: DataFrame, taken: list, picks: list[np.ndarray], value) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows of highest ``value(m, utility, near)`` in each partition, and the best of those each leaves out.

    All partitions together send ``MOST_SHORTLISTED`` rows, and one more each.
    """
    most = max(1, MOST_SHORTLISTED // max(1, rows.rdd.getNumPartitions()))

    def best(batches):
        top = None
        for each in batches:
            each = each[~each["key"].isin(taken)]
            if each.empty:
                continue
            m = _units(each["vector"])
            each = each.assign(vector=list(m), value=value(m, each["utility"].to_numpy(float), _nearest(m, picks)))
            top = (each if top is None else pd.concat([top, each])).sort_values(["value", "key"], ascending=[False, True]).head(most + 1)
        if top is not None:
            yield top.assign(beyond=np.arange(len(top)) == most)

    kinds = f"key {rows.schema['key'].dataType.simpleString()}, vector array<double>, utility double, value double, beyond boolean"
    found = pd.DataFrame(rows.mapInPandas(best, kinds).collect(), columns=["key", "vector", "utility", "value", "beyond"])
    beyond = found["beyond"].to_numpy(bool)
    return found[~beyond].sort_values("key", ignore_index=True), found[beyond].sort_values(["value", "key"], ascending=[False, True])


def _greedy(rows: DataFrame, k: int, first, later) -> list:
    """Keys of (key, vector, utility) by greedy order: the highest ``first``, then always the highest ``later``, lowest key among equals.

    Values only fall while picks are added, so the held rows decide as long as one is above all that no partition sent;
    after that all rows are valued anew.
    """
    keys: list = []
    picks: list[np.ndarray] = []
    while len(keys) < k:
        held, beyond = _best(rows, keys, picks, later if keys else first)
        if held.empty:
            break
        m, u, value = np.array(held["vector"].tolist(), float), held["utility"].to_numpy(float), held["value"].to_numpy(float)
        near, limit = _nearest(m, picks), None if beyond.empty else (beyond["value"].iloc[0], beyond["key"].iloc[0])
        started, fresh = bool(keys), True
        while len(keys) < k:
            i = int(np.argmax(value))
            key = held["key"].iloc[i]
            if value[i] == -np.inf or not fresh and limit and not (value[i] > limit[0] or value[i] == limit[0] and key < limit[1]):
                break
            near = np.maximum(near, _along(m, m[i])) if picks else _along(m, m[i])
            keys.append(key)
            picks.append(m[i])
            if not started:  # the first is chosen by another value
                break
            out = value == -np.inf
            value, fresh = later(m, u, near), False
            value[out] = -np.inf
            value[i] = -np.inf
    return [k.item() if isinstance(k, np.generic) else k for k in keys]


def _named(vectors: DataFrame, key: str, vector: str, utility: Column) -> DataFrame:
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"), utility.cast("double").alias("utility"))
    return rows.where("key is not null and vector is not null and utility is not null")


def k_center(vectors: DataFrame, key: str, vector: str, k: int) -> list:
    """Keys of the first k: the most central first, then always the one farthest from those before, lowest key among equals."""
    rows = _named(vectors, key, vector, F.lit(0.0))

    def total(batches):
        parts = [(_units(b["vector"]).sum(axis=0), len(b)) for b in batches if len(b)]
        if parts:
            yield pd.DataFrame({"total": [np.sum([t for t, _ in parts], axis=0)], "n": [sum(n for _, n in parts)]})

    sums = rows.mapInPandas(total, "total array<double>, n bigint").collect()
    if not sums:
        return []
    center = np.sum([r.total for r in sums], axis=0) / sum(r.n for r in sums)
    return _greedy(rows, k, lambda m, u, near: _along(m, center), lambda m, u, near: 1 - near)


def marginal_relevance(vectors: DataFrame, key: str, vector: str, utility: str, k: int, penalty: float = 0.5) -> list:
    """Keys of the first k: always the highest utility less ``penalty`` times the greatest likeness to those before."""
    worth = lambda m, u, near: u - penalty * near
    return _greedy(_named(vectors, key, vector, F.col(utility)), k, worth, worth)


def text_features(text: Column, size: int = 256) -> Column:
    """Unit vector of the square roots of hashed letter-trigram counts of a text, lower case."""
    t = F.lower(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.pmod(F.crc32(F.encode(F.substring(t, i, F.lit(3)), "utf-8")), F.lit(size)).cast("int"))
    zero = F.array_repeat(F.lit(0.0), size)
    # counts by bucket: sort once, then count runs by position of each bucket
    counts = F.aggregate(grams, zero, lambda acc, g: F.concat(F.slice(acc, F.lit(1), g), F.array(F.element_at(acc, g + 1) + 1.0), F.slice(acc, g + 2, F.lit(size))))
    return unit(F.transform(counts, F.sqrt))


def count_sketch(vectors: DataFrame, key: str, vector: str, size: int, seed: int = 1) -> DataFrame:
    """(key, bucket, value): seeded projection; each position adds with its sign to its bucket."""
    each = vectors.select(key, F.posexplode(vector).alias("i", "x"))
    h = F.xxhash64(F.lit(seed), "i")
    return each.groupBy(key, F.pmod(h, F.lit(size)).alias("bucket")).agg(F.sum(F.when(F.call_function("getbit", h, F.lit(62)) == 1, F.col("x")).otherwise(-F.col("x"))).alias("value"))



