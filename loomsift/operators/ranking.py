"""Ranks by a hashed order that no single key can overload, and budgeted fills."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsift.session import written


def seeded(seed: str, key: Column | str) -> Column:
    """Hex digest of ``seed:key``, the order that stands for a random one."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")), 256)


def hashed_rank(df: DataFrame, keys: list[str], digest: str, name: str = "rank") -> DataFrame:
    """1, 2, 3 … within ``keys`` in the order of the hex digest column.

    Rows are ranked within 4096 slices of the digest, and slices are placed by their counts, so even a
    key with a third of all rows is ranked by many tasks. Equal digests rank in no defined order.
    """
    sliced = df.withColumn("_slice", F.left(digest, F.lit(3)))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_here"))
    before = F.sum("_here").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_here")
    inside = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(digest))
    joined = joined_on(sliced.withColumn("_inside", inside), counts.select(*keys, "_slice", before.alias("_before")), [*keys, "_slice"])
    return joined.select(*df.columns, (F.col("_inside") + F.col("_before")).cast("bigint").alias(name))


def key_counts(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def joined_on(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys are kept once."""
    rest = [c for c in other.columns if c not in keys]
    renamed = other.select(*(F.col(k).alias(f"_on_{k}") for k in keys), *rest)
    same = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return df.join(renamed, same, how).select(*df.columns, *rest)


class Filled(NamedTuple):
    """What a fill takes of a placed table: the rows under ``whole`` and those in ``rows``, ``count`` together; ``left`` of the budget remains."""

    whole: Column
    rows: list[tuple]
    left: int
    count: int


def placed(items: DataFrame, order: list[Column], *others: str) -> DataFrame:
    """(id, tokens, place, others) of the items with a size, written; ``place`` rises in the order, ties by id, and no two rows share it."""
    n = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [f"_k{i}" for i in range(len(order))]
    ranged = items.select("id", "tokens", *others, *(c.alias(k) for c, k in zip(order, keys, strict=True))).where("tokens is not null")
    ordered = ranged.repartitionByRange(n, *keys, "id").sortWithinPartitions(*keys, "id", "tokens")
    return written(ordered.select("id", "tokens", F.monotonically_increasing_id().alias("place"), *others), "fill")


def fill(table: DataFrame, budget: int, block: int = 10_000, most: int | None = None) -> Filled:
    """The rows of a placed table taken one after the other, each that still fits the budget, until there are ``most``.

    Each pass sums the rows that can still fit by blocks of ``block`` places. Whole blocks are taken while
    they fit; the one in which the budget or number runs out comes to the driver, and the next pass goes on behind it.
    """
    whole, rows, left, at, count = F.lit(False), [], budget, 0, 0
    most = math.inf if most is None else most
    place, tokens = F.col("place"), F.col("tokens")
    while count < most:
        fits = table.where((place >= at) & (tokens <= left))
        sums = sorted(fits.groupBy(F.expr(f"place div {block}").alias("block")).agg(F.sum("tokens").alias("total"), F.count("*").alias("n")).collect())
        if not sums:
            break
        limit, split = left, None
        for r in sums:
            if r.total > left or count + r.n > most:
                split = r.block
                break
            left -= r.total
            count += r.n
        end = (sums[-1].block + 1 if split is None else split) * block
        if split != sums[0].block:
            whole = whole | ((place >= at) & (place < end) & (tokens <= limit))
        if split is None:
            break
        at = end + block
        for r in sorted(table.where((place >= end) & (place < at) & (tokens <= left)).select("place", "id", "tokens").collect(), key=lambda r: r.place):
            if r.tokens <= left and count < most:
                rows.append((r.id, r.tokens, r.place))
                left -= r.tokens
                count += 1
    return Filled(whole, rows, left, count)


def chosen(table: DataFrame, filled: Filled) -> DataFrame:
    """(id, tokens) of what a fill takes of a placed table."""
    first = table.where(filled.whole).select("id", "tokens", "place")
    return (first.unionByName(table.sparkSession.createDataFrame(filled.rows, first.schema)) if filled.rows else first).select("id", "tokens")


def static_fill(items: DataFrame, order: list[Column], budget: int, block: int = 10_000) -> DataFrame:
    """(id, tokens) of the items taken one after the other in order, each that still fits the budget."""
    table = placed(items, order)
    return chosen(table, fill(table, budget, block))
