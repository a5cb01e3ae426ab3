"""Spread across seeds, comparisons of arms, costs and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SEEDS = 3
#: Two-sided 95 % critical values of Student's t for 1 to 30 degrees of freedom. Fixed values.
T95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
#: Beyond the table: up to so many degrees of freedom this value holds. Fixed values.
T95_BEYOND = ((40, 2.042), (60, 2.021), (120, 2.000))
T95_LIMIT = 1.980


def t95(df: Column) -> Column:
    """The critical value, rounded to the wider interval; infinite below one degree of freedom."""
    beyond = F.lit(T95_LIMIT)
    for bound, value in reversed(T95_BEYOND):
        beyond = F.when(df < bound, value).otherwise(beyond)
    table = F.array(*map(F.lit, T95))
    return F.when(df < 1, F.lit(float("inf"))).when(df < len(T95) + 1, F.get(table, F.floor(df).cast("int") - 1)).otherwise(beyond)


def per_seed(values: DataFrame, keys: list[str], seed: str, value: str) -> DataFrame:
    return values.groupBy(*keys, seed).agg(F.avg(value).alias("value"))


def across_seeds(values: DataFrame, keys: list[str], seed: str, value: str) -> DataFrame:
    """Number, mean, sample deviation (null for one seed), least and most of the per-seed means."""
    return per_seed(values, keys, seed, value).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def welch(spread: DataFrame, arm: str, baseline: str, higher_is_better: bool = True) -> DataFrame:
    """Each arm against a baseline: difference (positive is better), interval and verdict.

    ``spread`` is what across_seeds() gives for one key, the arm.
    """
    base = spread.where(F.col(arm) == baseline).select(*(F.col(c).alias(f"b_{c}") for c in ("n", "mean", "std")))
    # The baseline is one row.
    both = spread.where(F.col(arm) != baseline).join(F.broadcast(base), F.lit(True))
    sign = 1.0 if higher_is_better else -1.0
    va, vb = F.pow("std", F.lit(2)) / F.col("n"), F.pow("b_std", F.lit(2)) / F.col("b_n")
    part = lambda v, n: F.when(v > 0, v * v / (F.col(n) - 1)).otherwise(F.lit(0.0))
    out = both.select(arm, (sign * (F.col("mean") - F.col("b_mean"))).alias("difference"), F.least("n", "b_n").alias("seeds"), F.sqrt(va + vb).alias("se"), ((va + vb) * (va + vb) / (part(va, "n") + part(vb, "b_n"))).alias("df"), F.greatest(F.lit(1.0), F.abs("mean"), F.abs("b_mean")).alias("scale"))
    half = t95(F.col("df")) * F.col("se")
    enough = (F.col("seeds") >= MIN_SEEDS) & (F.col("se") > 1e-9 * F.col("scale"))
    low, high = F.when(enough, F.col("difference") - half), F.when(enough, F.col("difference") + half)
    verdict = F.when(low > 0, "supported").when(high < 0, "contradicted").otherwise("insufficient_evidence")
    return out.select(arm, "difference", low.alias("low"), high.alias("high"), verdict.alias("verdict"))


def bootstrap(values: DataFrame, value: str, samples: int = 200, seed: int = 0) -> DataFrame:
    """(low, high): 95 % interval of the mean over resamples, drawn by Poisson weights from a hash of row and resample.

    Each row weighs in on each resample where it stands, so nothing is collected and one pass serves all resamples.
    """
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed), F.col("_row"), s), F.lit(1 << 40)) / float(1 << 40))
    cuts = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)  # cumulated Poisson(1)
    weight = lambda s: sum(((u(s) > c).cast("int") for c in cuts), F.lit(0))
    rows = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), F.monotonically_increasing_id().alias("_row"))
    each = rows.select("x", F.explode(F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda s: F.struct(s.alias("s"), weight(s).alias("w")))).alias("r")).where("r.w > 0")
    means = each.groupBy("r.s").agg((F.sum(F.col("x") * F.col("r.w")) / F.sum("r.w")).alias("m"))
    ordered = means.agg(F.sort_array(F.collect_list("m")).alias("m"))  # ``samples`` values
    return ordered.select(F.get("m", F.lit(int(0.025 * samples))).alias("low"), F.get("m", F.lit(min(samples - 1, int(0.975 * samples)))).alias("high"))


def ledger(entries: DataFrame, stage: str, cost: str, stages: list[str]) -> DataFrame:
    """Entries and cost of each stage, stages without entries included, and the share of the whole."""
    spent = entries.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("entries"), F.sum(cost).alias("cost"))
    known = entries.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    filled = known.join(spent, "stage", "left").select("stage", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("cost", F.lit(0.0)).alias("cost"))
    total = filled.agg(F.sum("cost").alias("t")).first().t or 0.0
    return filled.withColumn("share", F.round(F.col("cost") / F.lit(total if total else 1.0), 4))


def retention_gate(spread: DataFrame, baseline: DataFrame, capability: str, tolerance: float) -> DataFrame:
    """(capability, change, kept): whether the mean of each capability fell by no more than the tolerance."""
    both = spread.select(capability, "mean").join(baseline.select(capability, F.col("mean").alias("base")), capability)
    return both.select(capability, (F.col("mean") - F.col("base")).alias("change"), (F.col("mean") - F.col("base") >= -tolerance).alias("kept"))


def best_candidate(arms: DataFrame, budget: float, baseline: float) -> DataFrame:
    """The arm of highest mean that fits the budget, kept its capabilities and beats the baseline; ties to the smaller budget, then the last name."""
    fit = arms.where((F.col("budget") <= budget) & F.col("kept") & (F.col("mean") > baseline))
    return fit.orderBy(F.desc("mean"), "budget", F.desc("arm")).limit(1)


def learning_rate(step: Column, total: int, warmup_ratio: float, schedule: str = "linear") -> Column:
    """Multiplier at a step counted from 0."""
    warm = int(warmup_ratio * total)
    after = F.lit(1.0) if schedule == "constant" else F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(max(1, total - warm)))
    return F.when(step < warm, (step + 1) / F.lit(max(warm, 1))).otherwise(after)


def training_cost(tokens: Column, epochs: int, backward: float = 2.0) -> Column:
    """Forward-token equivalents of training on so many tokens."""
    return (1 + backward) * tokens * epochs
