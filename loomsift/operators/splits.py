"""Splits of records: halves, prompt-hash splits, caps, leakage between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions.text import WHITE, bound, strip
from loomsift.operators.ranking import hashed_rank, joined_on, key_counts, seeded
from loomsift.session import written

SHINGLE_WORDS = 5
SIMILARITY = 0.8


def record_id(raw: Column) -> Column:
    """Name of a raw line: the first half of its digest."""
    return F.concat(F.lit("sha256:"), F.left(F.sha2(raw, 256), F.lit(32)))


def split_halves(df: DataFrame, capability: str, key: str, seed: str = "7", fraction: float = 0.5) -> DataFrame:
    """(key, capability, half): within each capability, a rounded share of the rows in hashed order is ``selection``.

    Each half keeps at least one row; a capability of a single row has half null.
    """
    ranked = hashed_rank(df.select(key, capability).withColumn("digest", seeded(seed, key)), [capability], "digest")
    counted = joined_on(ranked, key_counts(df, [capability]), [capability])
    take = F.least(F.col("n") - 1, F.greatest(F.lit(1), F.bround(F.col("n") * fraction)))
    half = F.when(F.col("n") >= 2, F.when(F.col("rank") <= take, "selection").otherwise("comparison"))
    return counted.select(key, capability, half.alias("half"))


def split_by_prompt(df: DataFrame, category: str, prompt: str, key: str, test: int, dev: int) -> DataFrame:
    """(key, category, part): in each category the first ``test`` distinct prompts by digest go to test, the next ``dev`` to dev.

    All rows of a category with a chosen prompt follow it; rows of other categories with that prompt are dropped.
    """
    rows = df.select(key, category, F.sha2(prompt, 256).alias("digest")).where(F.col(prompt).isNotNull())
    ranked = hashed_rank(rows.select(category, "digest").distinct(), [category], "digest")
    part = F.when(F.col("rank") <= test, "test").when(F.col("rank") <= test + dev, "dev")
    chosen = ranked.withColumn("part", part).where("part is not null").select(category, "digest", "part")
    own = joined_on(rows, chosen, [category, "digest"], "left")
    elsewhere = chosen.select("digest").distinct().withColumn("held", F.lit(True))
    placed = own.join(elsewhere, "digest", "left")
    return placed.where("part is not null or held is null").select(key, category, F.coalesce("part", F.lit("train")).alias("part"))


def capped(df: DataFrame, category: str, key: str, most: int) -> DataFrame:
    """Rows cut to about ``most`` in all, each category to its rounded share, lowest digests first."""
    ranked = hashed_rank(df.select(key, category).withColumn("digest", F.sha2(F.col(key).cast("string"), 256)), [category], "digest")
    counts = key_counts(df, [category])
    total = counts.agg(F.sum("n").alias("total")).first().total or 0
    return joined_on(ranked, counts, [category]).where(F.col("rank") <= F.bround(F.col("n") * F.lit(most / max(total, 1)))).select(key, category)


def first_seen(df: DataFrame, key: str, prompt: str, answer: str) -> DataFrame:
    """(key) of rows with a prompt and an answer, the first of each trimmed pair."""
    some = df.select(key, strip(F.col(prompt)).alias("p"), strip(F.col(answer)).alias("a")).where("p <> '' and a <> ''")
    return some.groupBy(F.sha2(F.concat("p", F.lit("\x00"), "a"), 256).alias("digest")).agg(F.min(key).alias(key)).select(key)


def shingles(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of the runs of ``size`` words; a shorter text is one run."""
    def runs(words: Column) -> Column:
        count = F.greatest(F.size(words) - (size - 1), F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(size)), " "))))

    return bound(F.filter(F.split(F.lower(text), f"{WHITE}+"), lambda w: w != ""), runs)


def near_duplicates(left: DataFrame, right: DataFrame, key: str, text: str, least: float = SIMILARITY) -> DataFrame:
    """(left_key, right_key, similarity): for each left text, the links to right texts with a shingle Jaccard of ``least`` or more.

    Equal texts are one on either side, named by their lowest key. Shingles are put in order of how
    rare they are on the right, and only the prefix of each text is joined: two texts that are similar
    enough share a shingle of both prefixes, so no link is lost and common shingles meet nothing.
    """
    distinct = lambda df: df.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("t")).agg(F.min(key).alias("k")).select("k", shingles(F.col("t")).alias("s"))
    a, b = written(distinct(left), "left-shingles"), written(distinct(right), "right-shingles")
    df = b.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("n"))

    def prefix(side: DataFrame, name: str) -> DataFrame:
        rows = side.select(F.col("k").alias(name), F.size("s").alias(f"{name}_size"), F.explode("s").alias("x")).join(df, "x", "left")
        order = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x")))
        kept = F.slice("o", F.lit(1), F.col(f"{name}_size") - F.ceil(F.col(f"{name}_size") * least - 1e-9).cast("int") + 1)
        return rows.groupBy(name, f"{name}_size").agg(order.alias("o")).select(name, f"{name}_size", F.explode(kept).alias("e")).where("e.n > 0").select(name, f"{name}_size", F.col("e.x").alias("x"))

    pairs = prefix(a, "left_key").join(prefix(b, "right_key"), "x")
    short, long = F.least("left_key_size", "right_key_size"), F.greatest("left_key_size", "right_key_size")
    candidates = pairs.where(short >= long * least - 1e-9).select("left_key", "right_key").distinct()
    both = candidates.join(a.select(F.col("k").alias("left_key"), F.col("s").alias("ls")), "left_key").join(b.select(F.col("k").alias("right_key"), F.col("s").alias("rs")), "right_key")
    shared = F.size(F.array_intersect("ls", "rs"))
    measured = both.select("left_key", "right_key", (shared / (F.size("ls") + F.size("rs") - shared)).alias("similarity"))
    return measured.where(F.col("similarity") >= least - 1e-12)


def leakage(left: DataFrame, right: DataFrame, key: str, text: str, group: str | None = None) -> DataFrame:
    """(key, other, kind, similarity): the strongest finding for each left row, exact text before related group before near copy."""
    own = left.select(key, F.lower(text).alias("t"), *([F.col(group).alias("g")] if group else [F.lit(None).cast("string").alias("g")])).where("t is not null")
    exact = right.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("t")).agg(F.min(key).alias("exact"))
    found = own.join(exact, "t", "left")
    if group:
        related = right.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.min(key).alias("related"))
        found = found.join(related, "g", "left")
    else:
        found = found.withColumn("related", F.lit(None).cast("bigint"))
    links = near_duplicates(left, right, key, text)
    best = links.groupBy("left_key").agg(F.max(F.struct("similarity", (-F.col("right_key")).alias("r"))).alias("b"))
    # links name the lowest key of equal texts; every copy takes its link from there
    named = own.groupBy("t").agg(F.min(key).alias("left_key")).join(best, "left_key").select("t", F.col("b.similarity").alias("similarity"), (-F.col("b.r")).alias("near"))
    found = found.join(named, "t", "left")
    kind = F.when(F.col("exact").isNotNull(), "exact").when(F.col("related").isNotNull(), "related").when(F.col("near").isNotNull(), "near")
    share = F.when(F.col("exact").isNotNull(), F.lit(1.0)).when(F.col("related").isNull(), F.round("similarity", 4))
    return found.where(kind.isNotNull()).select(key, F.coalesce("exact", "related", "near").alias("other"), kind.alias("kind"), share.alias("similarity"))


def leakage_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind").agg(F.count("*").alias("records"))
