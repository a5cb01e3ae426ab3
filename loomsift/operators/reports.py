"""Aggregates over records and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.functions.text import WHITE
from loomsift.operators import records as rec
from loomsift.operators import rules
from loomsift.schema import ERROR, INFO, MAX_SEQ_LEN, SEVERITY_RANK, WARNING

AT_RISK = 0.85


def by_rule(findings: DataFrame) -> DataFrame:
    """Findings of each rule by severity."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy("rule_id").agg(count(ERROR).alias("errors"), count(WARNING).alias("warnings"), count(INFO).alias("infos"))


def affected_lines(findings: DataFrame) -> DataFrame:
    """Distinct lines with an error and with a warning, by file."""
    lines = lambda s: F.count_distinct(F.when(F.col("severity") == s, F.col("line_no")))
    return findings.groupBy("file").agg(lines(ERROR).alias("error_lines"), lines(WARNING).alias("warning_lines"))


def valid_lines(records: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, line_no) of the records without an error."""
    wrong = findings.where(F.col("severity") == ERROR).select("file", "line_no")
    return records.select("file", "line_no").join(wrong, ["file", "line_no"], "left_anti")


def ordered(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings by severity, line and rule order; ``limit`` bounds the list, never the counts."""
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv))
    listed = findings.withColumn("rank", rank[F.col("severity")]).orderBy("rank", F.asc_nulls_last("line_no"), "rule_order", F.asc_nulls_first("idx"), "file", "kind")
    return listed.limit(limit) if limit is not None else listed


def by_format(records: DataFrame) -> DataFrame:
    return records.groupBy("source_format").agg(F.count("*").alias("records"))


def role_histogram(records: DataFrame) -> DataFrame:
    """Messages by role, the rejected side left out; a missing role is ``invalid``."""
    each = records.select(F.explode("messages").alias("m"))
    return each.groupBy(F.coalesce(F.left("m.role", F.lit(40)), F.lit("invalid")).alias("role")).agg(F.count("*").alias("messages"))


def turn_stats(records: DataFrame) -> DataFrame:
    """Fewest, median and most messages of a record, and records that end on the assistant, by file."""
    some = records.where(F.size("messages") > 0).select("file", F.size("messages").cast("bigint").alias("n"), (F.element_at("messages", -1)["role"] == "assistant").alias("ends"))
    return some.groupBy("file").agg(F.min("n").alias("fewest"), F.percentile("n", F.lit(0.5)).cast("bigint").alias("middle"), F.max("n").alias("most"), F.count_if("ends").alias("end_on_assistant"))


def token_stats(records: DataFrame, budget: int = MAX_SEQ_LEN) -> DataFrame:
    """Records over and near the budget, median and largest estimate, by file."""
    t = F.col("tokens")
    near = (t >= AT_RISK * budget) & (t <= budget)
    return rules.record_tokens(records).groupBy("file").agg(
        F.count("*").alias("records"), F.count_if(t > budget).alias("over"), F.count_if(near).alias("at_risk"), F.percentile("tokens", F.lit(0.5)).cast("bigint").alias("middle"), F.max("tokens").alias("largest")
    )


def duplicate_stats(records: DataFrame) -> DataFrame:
    """Clusters of equal records, copies beyond the first, and the largest cluster, by file."""
    sizes = rules.content_key(records).groupBy("file", "full_key").agg(F.count("*").alias("n")).where("n > 1")
    return sizes.groupBy("file").agg(F.count("*").alias("clusters"), F.sum(F.col("n") - 1).alias("redundant"), F.max("n").alias("largest"))


def rates(records: DataFrame, findings: DataFrame) -> DataFrame:
    """Share of records without an error, with an error, with a warning, and redundant, by file."""
    total = records.groupBy("file").agg(F.count("*").alias("total"))
    lines = affected_lines(findings)
    joined = total.join(lines, "file", "left").join(duplicate_stats(records).select("file", "redundant"), "file", "left")
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.greatest(F.lit(1), F.col("total"))
    return joined.select("file", "total", (1 - share("error_lines")).alias("clean_fraction"), share("error_lines").alias("error_rate"), share("warning_lines").alias("warning_rate"), share("redundant").alias("duplicate_rate"))


def regressions(now: DataFrame, baseline: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rates that got worse than a baseline of the same file: (file, metric, before, after)."""
    falls = ("clean_fraction",)
    rises = ("error_rate", "warning_rate", "duplicate_rate")
    flat = lambda df, name: df.select("file", F.explode(F.map_from_arrays(F.array(*map(F.lit, falls + rises)), F.array(*map(F.col, falls + rises)))).alias("metric", name))
    both = flat(now, "after").join(flat(baseline, "before"), ["file", "metric"])
    worse = F.when(F.col("metric").isin(*falls), F.col("after") < F.col("before") - tolerance).otherwise(F.col("after") > F.col("before") + tolerance)
    return both.where(worse).select("file", "metric", "before", "after")


def exit_codes(records: DataFrame, findings: DataFrame) -> DataFrame:
    """2 with errors, 1 with warnings, else 0, by file."""
    worst = findings.groupBy("file").agg(F.max(F.when(F.col("severity") == ERROR, 2).when(F.col("severity") == WARNING, 1).otherwise(0)).alias("worst"))
    return records.select("file").distinct().join(worst, "file", "left").select("file", F.coalesce("worst", F.lit(0)).cast("bigint").alias("exit_code"))


def snapshot(findings: DataFrame) -> DataFrame:
    """(file, line_no, rules): the rules that hit each line as a bit mask in rule order."""
    return findings.where("line_no is not null").groupBy("file", "line_no").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("rule_order").cast("int"))).alias("rules"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("file", "disposition").agg(F.count("*").alias("records"))


def fixes_by_rule(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(F.explode("rules_fixed").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("fixes"))


def word_overlap(pairs: DataFrame, before: str, after: str, keys: list[str]) -> DataFrame:
    """Share of words kept from ``before`` and share of ``after`` that is new, words counted with repeats; both rounded to 4."""
    words = lambda c: F.filter(F.split(c, f"{WHITE}+"), lambda w: w != "")
    # counts by word stay within a row: as many as its text has words
    counted = lambda c, n: F.size(F.filter(c, lambda x: x == n))
    a, b = words(F.col(before)), words(F.col(after))
    shared = F.aggregate(F.transform(F.array_distinct(a), lambda w: F.least(counted(a, w), counted(b, w))), F.lit(0), lambda s, x: s + x)
    kept = F.round(shared / F.greatest(F.lit(1), F.size(a)), 4)
    added = F.round((F.size(b) - shared) / F.greatest(F.lit(1), F.size(b)), 4)
    return pairs.select(*keys, kept.alias("kept"), added.alias("added"))


def query_rows(records: DataFrame, findings: DataFrame, text: str) -> DataFrame:
    """(file, line_no) of the records that a row query selects; its terms must all hold.

    Terms: rule:NAME (a prefix), state:error|warning|clean, tokens>N, tokens<N, line:A-B, dup, text:"words" or a bare word.
    """
    import shlex

    rows = records.select("file", "line_no", "messages", "rejected", "prompt_len")
    base = rows.select("file", "line_no")
    for term in shlex.split(text):
        key, _, value = term.partition(":")
        if key == "rule" and value:
            base = base.join(findings.where(F.startswith("rule_id", F.lit(value))).select("file", "line_no"), ["file", "line_no"], "left_semi")
        elif key == "state" and value in (ERROR, WARNING):
            base = base.join(findings.where(F.col("severity") == value).select("file", "line_no"), ["file", "line_no"], "left_semi")
        elif key == "state" and value == "clean":
            base = base.join(findings.where(F.col("severity") != INFO).select("file", "line_no"), ["file", "line_no"], "left_anti")
        elif term[:7] in ("tokens>", "tokens<") and term[7:].isdigit():
            t = F.col("tokens")
            hit = rules.record_tokens(rows).where(t > int(term[7:]) if term[6] == ">" else t < int(term[7:]))
            base = base.join(hit.select("file", "line_no"), ["file", "line_no"], "left_semi")
        elif key == "line" and value:
            low, _, high = value.partition("-")
            base = base.where(F.col("line_no").between(int(low), int(high or low)))
        elif term == "dup":
            base = base.join(rules.duplicates(rows).select("file", "line_no"), ["file", "line_no"], "left_semi")
        else:
            wanted = (value if key == "text" and value else term).lower()
            hit = rec.slots(rows).where(F.contains(F.lower("content"), F.lit(wanted))).select("file", "line_no")
            base = base.join(hit, ["file", "line_no"], "left_semi")
    return base
