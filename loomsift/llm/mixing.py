"""Mixing sources to target weights (problem 7).

Texts are aggregated by membership pattern: the set of wanted sources a text stands in.
A min-cost flow routes the tokens of each pattern to the quotas of its sources; every
further use of a pattern costs more than the one before, so repeats spread evenly and
are taken only where a source needs them. Texts are then selected in the order of a
seeded hash: each pattern's texts are used as often as its flow says, and the last round
goes to the first texts of that order.

A text counts once however many documents hold it. A text in several sources may be used
as often as the strictest of them allows. Null texts, texts of no tokens, null sources
and sources without a target are left out; a target whose source is absent gets nothing
and its share is spread over the others in proportion. Shares must not be negative.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.session import written

BUCKET_TEXTS = 8192


class Target(NamedTuple):
    share: float
    max_repeats: int


class Flow:
    """Min-cost flow by successive cheapest paths; capacities are amounts of tokens."""

    def __init__(self) -> None:
        self.edges: list[list] = []  # [to, capacity, cost]; edge e runs back as e ^ 1
        self.out: dict[object, list[int]] = defaultdict(list)

    def edge(self, a: object, b: object, capacity: float, cost: int = 0) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0.0, -cost])
        return len(self.edges) - 2

    def run(self, source: object, sink: object, least: float = 1e-6) -> float:
        total = 0.0
        while True:
            cost: dict[object, float] = {source: 0}
            via: dict[object, int] = {}
            queue = [source]
            waiting = {source}
            while queue:
                a = queue.pop(0)
                waiting.discard(a)
                for e in self.out[a]:
                    b, capacity, price = self.edges[e]
                    if capacity > least and cost[a] + price < cost.get(b, math.inf) - 1e-12:
                        cost[b], via[b] = cost[a] + price, e
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if sink not in via:
                return total
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.edges[via[at] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount
            total += amount


def route(patterns: dict[tuple[str, ...], float], targets: dict[str, Target], total: float) -> tuple[dict[tuple[tuple[str, ...], str], float], float]:
    """Tokens of each pattern that go to each source, and how many could be routed in all."""
    flow = Flow()
    for name, target in targets.items():
        flow.edge(("source", name), "sink", target.share * total)
    carried = {}
    for pattern, tokens in patterns.items():
        for nth in range(min(targets[s].max_repeats for s in pattern)):
            flow.edge("start", ("pattern", pattern), tokens, nth)
        for name in pattern:
            carried[pattern, name] = flow.edge(("pattern", pattern), ("source", name), math.inf)
    routed = flow.run("start", "sink", least=max(1e-6, total * 1e-12))
    return {k: flow.edges[e ^ 1][1] for k, e in carried.items() if flow.edges[e ^ 1][1] > 1e-6}, routed


def largest_total(patterns: dict[tuple[str, ...], float], targets: dict[str, Target]) -> float:
    """The most tokens at which every source still reaches its share."""
    low, high = 0.0, float(sum(t * max(targets[s].max_repeats for s in p) for p, t in patterns.items()))
    for _ in range(60):
        middle = (low + high) / 2
        if route(patterns, targets, middle)[1] >= middle * (1 - 1e-9):
            low = middle
        else:
            high = middle
    return low


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """The texts of one bucket that still fit, in their order."""
    group = group.sort_values(["order", "h1", "h2"])
    room, last = float(group.room.iloc[0]), []
    for n in group.tokens:
        last.append(int(n <= room + 1e-6))
        room -= n * last[-1]
    return group[["pattern", "h1", "h2"]].assign(last=pd.array(last, "int32"))


def read_targets(targets: DataFrame, most: int = 1000) -> dict[str, Target]:
    """Targets by source; the table is a list of wanted shares of bounded size, a longer one is an error."""
    rows = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} targets")
    if any(r.share is not None and r.share < 0 for r in rows):
        raise ValueError("a share is negative")
    return {r.source: Target(r.share, max(r.repeats or 0, 0)) for r in rows if r.share}


def mixture(sized: DataFrame, targets: dict[str, Target], seed: int = 1, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: (doc_id, source, repeats, tokens), one row for each text and source it counts for; repeats is how often
    the text is used for it, tokens its size. shares: (source, target_share, quota_share, tokens, actual_share).
    ``sized`` has doc_id, source, h1, h2 (two hashes of the text) and tokens. ``total_tokens`` is the size wanted;
    without it, the most at which every present source reaches its share.
    """
    spark = sized.sparkSession
    chosen_schema = "doc_id bigint, source string, repeats bigint, tokens bigint"
    share_schema = "source string, target_share double, quota_share double, tokens bigint, actual_share double"
    wanted = [s for s, t in targets.items() if t.max_repeats > 0]
    some = sized.where(F.col("source").isin(wanted) & (F.col("tokens") > 0))
    one = some.groupBy("h1", "h2", "source").agg(F.min("doc_id").alias("doc_id"), F.min("tokens").alias("tokens"))
    # A text has at most as many members as there are targets.
    texts = one.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("members"), F.min("tokens").alias("tokens"))
    texts = texts.select("h1", "h2", "members", "tokens", F.array_join("members.source", "\x01").alias("pattern"), F.xxhash64(F.lit(seed), "h1", "h2").alias("order"))
    texts = written(texts, "mix-texts")
    # Patterns are sets of targets that occur together: their number does not grow with the texts.
    found = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts")).collect()
    patterns = {tuple(r.pattern.split("\x01")): float(r.tokens) for r in found}
    present = {s for p in patterns for s in p}
    whole = sum(targets[s].share for s in present)
    quota = {s: Target(targets[s].share / whole, targets[s].max_repeats) for s in present}
    if patterns:
        total = largest_total(patterns, quota) if total_tokens is None else float(total_tokens)
        flows, _ = route(patterns, quota, total)
    else:
        flows = {}
    plan = []
    for pattern, tokens in patterns.items():
        own = [(s, flows.get((pattern, s), 0.0)) for s in pattern]
        used = sum(x for _, x in own)
        rounds, rest = divmod(round(used), round(tokens))
        ends, at = [], 0.0
        for s, x in own:
            at += x
            ends.append((s, float(at)))
        plan.append(("\x01".join(pattern), int(rounds), float(rest), float(tokens), [{"source": s, "end": e} for s, e in ends]))
    if not plan:
        shares = spark.createDataFrame([(s, t.share, 0.0, 0, 0.0) for s, t in targets.items()], share_schema)
        return spark.createDataFrame([], chosen_schema), shares
    rules = spark.createDataFrame(plan, "pattern string, rounds int, rest double, size double, ends array<struct<source: string, end: double>>")
    count = sum(r.texts for r in found)
    buckets = max(1, -(-count // BUCKET_TEXTS))
    placed = texts.withColumn("bucket", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * buckets))
    sums = placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("here"))
    before = F.sum("here").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("here")
    inside = F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("order", "h1", "h2")) - F.col("tokens")
    # rules has a row for each pattern, at most 2 to the number of targets and far fewer in any data.
    lined = placed.withColumn("inside", inside).join(sums.select("pattern", "bucket", "here", before.alias("before")), ["pattern", "bucket"]).join(F.broadcast(rules), "pattern")
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("here") > F.col("rest"))
    lined = lined.withColumn("edge", edge)
    # The last round ends inside one bucket of each pattern; there, texts that fit are taken in order.
    picks = lined.where("edge").select("pattern", "h1", "h2", "order", "tokens", (F.col("rest") - F.col("before")).alias("room")).groupBy("pattern").applyInPandas(_fill, "pattern string, h1 bigint, h2 bigint, last int")
    inner = lined.where("not edge").withColumn("last", (F.col("before") + F.col("here") <= F.col("rest")).cast("int"))
    outer = lined.where("edge").join(picks, ["pattern", "h1", "h2"], "left").withColumn("last", F.coalesce("last", F.lit(0)))
    lined = inner.unionByName(outer)
    start = F.col("inside") + F.col("before")
    uses = F.col("rounds") + F.col("last")
    each = lined.withColumn("start", start).withColumn("uses", uses).where("uses > 0")
    each = each.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    middle = F.col("nth") * F.col("size") + F.col("start") + F.col("tokens") / 2
    charged = F.coalesce(F.get(F.filter("ends", lambda e: middle <= e["end"]), F.lit(0))["source"], F.element_at("ends", -1)["source"])
    each = each.withColumn("source", charged)
    doc = F.get(F.filter("members", lambda m: m["source"] == F.col("source")), F.lit(0))["doc_id"]
    chosen = each.select(doc.alias("doc_id"), "source", "tokens").groupBy("doc_id", "source").agg(F.count("*").alias("repeats"), F.min("tokens").alias("tokens"))
    chosen = written(chosen.select("doc_id", "source", "repeats", "tokens"), "mix-chosen")
    sizes = chosen.groupBy("source").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("tokens"))
    wants = spark.createDataFrame([(s, t.share, quota[s].share if s in quota else 0.0) for s, t in targets.items()], "source string, target_share double, quota_share double")
    filled = wants.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    # A row for each target.
    shares = filled.withColumn("actual_share", F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1)))
    return chosen, shares.select("source", "target_share", "quota_share", "tokens", "actual_share")
