"""check, fix, report and rules over JSON-lines files, with exit codes.

Exit codes: 2 with errors, 1 with warnings, 0 otherwise, for a check; 2 where nothing is left,
1 where records were dropped, 0 otherwise, for a fix; 3 for a regression or a run that failed.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.operators import repair, reports, rules
from loomsift.schema import EMPTY_CALLS, ERROR, MAX_SEQ_LEN, RULES, SEVERITY_RANK, WARNING, disabled_rules
from loomsift.session import workers_find_package, written
from loomsift.sources import jsonl

SCHEMA_VERSION = 1


@dataclass
class CheckResult:
    records: DataFrame
    findings: DataFrame
    counts: list[dict] = field(default_factory=list)
    total: int = 0
    valid: int = 0

    @property
    def exit_code(self) -> int:
        return 2 if any(c["errors"] for c in self.counts) else 1 if any(c["warnings"] for c in self.counts) else 0

    def to_dict(self, limit: int | None = None) -> dict:
        """A bounded document: ``limit`` caps the list of findings, never the counts."""
        listed = [r.asDict() for r in reports.ordered(self.findings, 1000 if limit is None else limit).drop("rank", "rule_order").collect()]
        known = sum(c["errors"] + c["warnings"] + c["infos"] for c in self.counts)
        return {"schema_version": SCHEMA_VERSION, "exit_code": self.exit_code, "total_records": self.total, "valid_records": self.valid, "by_rule": self.counts, "issues": listed, "issues_truncated": known > len(listed)}


def _lines(spark: SparkSession, paths: list[str] | str, shape: str) -> DataFrame:
    workers_find_package(spark)
    return jsonl.parse(jsonl.read_lines(spark, paths), shape)


def held_out_records(spark: SparkSession, path: str) -> DataFrame:
    """The evaluation set; a line that does not parse or has faulty fields is an error, a partial set is never used."""
    records = _lines(spark, path, "auto")
    if bad := records.where(F.col("parse_error").isNotNull() | (F.size("field_errors") > 0)).count():
        raise ValueError(f"the evaluation set has {bad} faulty lines")
    return records


def findings_of(parsed: DataFrame, off: set[str], held_out: DataFrame | None, max_seq_len: int) -> DataFrame:
    """Findings of parsed lines: what the parser saw, then the rules over the records that parsed."""
    order = {r.id: r.order for r in RULES.values()}
    said = lambda rows, rule, kind, severity=ERROR: rows.select(
        "file", "line_no", F.lit(rule).alias("rule_id"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(None).cast("bigint").alias("idx"), kind.alias("kind"), F.lit(order[rule]).alias("rule_order")
    )
    broken = said(parsed.where("parse_error is not null"), "schema", F.concat(F.lit("invalid JSON: "), "parse_error"))
    whole = parsed.where("parse_error is null")
    faulty = said(whole.where(F.size("field_errors") > 0).withColumn("e", F.explode("field_errors")), "schema", F.col("e"))
    out = rules.findings(whole.where(F.size("field_errors") == 0), off, held_out, max_seq_len).unionByName(broken).unionByName(faulty)
    if "tool-calls" not in off:
        e = F.col("e")
        tools = whole.where(F.size("tool_errors") > 0).withColumn("e", F.explode("tool_errors"))
        out = out.unionByName(said(tools, "tool-calls", e, F.when(e == EMPTY_CALLS, WARNING).otherwise(ERROR)))
    return out


def check(spark: SparkSession, paths: list[str] | str, shape: str = "auto", eval_path: str | None = None, disable: list[str] | None = None, max_seq_len: int = MAX_SEQ_LEN, output: str | None = None) -> CheckResult:
    """Findings of one or more files; ``output`` takes the lines without errors, in order, as a folder of text parts."""
    off = disabled_rules(disable)
    refuse_same(paths, output)
    parsed = written(_lines(spark, paths, shape), "parsed")
    held_out = held_out_records(spark, eval_path) if eval_path else None
    found = written(findings_of(parsed, off, held_out, max_seq_len), "findings")
    counts = [r.asDict() for r in reports.by_rule(found).orderBy("rule_id").collect()]  # a row for each rule
    clean = reports.valid_lines(parsed, found)
    result = CheckResult(parsed, found, counts, parsed.count(), clean.count())
    if output:
        parsed.join(clean, ["file", "line_no"], "left_semi").orderBy("file", "line_no").select("raw").write.text(output)
    return result


def refuse_same(paths: list[str] | str, output: str | None) -> None:
    """An output that is one of the inputs is an error."""
    for path in [paths] if isinstance(paths, str) else paths:
        if output and os.path.realpath(path.removeprefix("file://")) == os.path.realpath(output.removeprefix("file://")):
            raise ValueError("the output is an input")


@dataclass
class FixResult:
    outcomes: DataFrame
    lines: DataFrame
    counts: dict[str, int]
    by_rule: dict[str, int]
    fixer_errors: list[str] = field(default_factory=list)

    @property
    def emitted(self) -> int:
        return self.counts.get("unchanged", 0) + self.counts.get("fixed", 0)

    @property
    def exit_code(self) -> int:
        return 2 if not self.emitted else 1 if self.counts.get("dropped", 0) or self.counts.get("unparseable", 0) or self.fixer_errors else 0

    def to_dict(self) -> dict:
        return {"schema_version": SCHEMA_VERSION, "exit_code": self.exit_code, "summary": self.counts | {"emitted": self.emitted}, "fixes_by_rule": self.by_rule, "fixer_errors": self.fixer_errors}


def fix(spark: SparkSession, paths: list[str] | str, output: str | None = None, shape: str = "auto", eval_path: str | None = None, disable: list[str] | None = None, max_seq_len: int = MAX_SEQ_LEN) -> FixResult:
    """Repaired records in their source shape; lines that did not change keep their bytes."""
    off = disabled_rules(disable)
    refuse_same(paths, output)
    parsed = written(_lines(spark, paths, shape), "parsed")
    held_out = held_out_records(spark, eval_path) if eval_path else None
    broken = F.col("parse_error").isNotNull() | (F.size("field_errors") > 0)
    usable, rest = parsed.where(~broken), parsed.where(broken)
    none = F.array().cast("array<string>")
    fixed = repair.fixed(usable, held_out, off, max_seq_len)
    why = F.when(F.col("parse_error").isNotNull(), "unparseable").otherwise("dropped")
    lost = rest.select("file", "line_no", why.alias("disposition"), none.alias("rules_fixed"), F.when(F.col("parse_error").isNull(), F.array(F.lit("schema"))).otherwise(none).alias("rules_unfixable"))
    outcomes = written(fixed.unionByName(lost, allowMissingColumns=True), "outcomes")
    kept = outcomes.where("disposition in ('unchanged', 'fixed')").join(usable.select("file", "line_no", "raw", "source_format"), ["file", "line_no"])
    lines = jsonl.written_back(kept.withColumn("changed", F.col("disposition") == "fixed"), off)
    if output:
        lines.orderBy("file", "line_no").select("raw").write.text(output)
    counts = {r.disposition: r.n for r in outcomes.groupBy("disposition").agg(F.count("*").alias("n")).collect()}
    troubles = outcomes.where("error is not null").groupBy("error").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no")).orderBy("error").collect()  # a row for each kind of failure
    by_rule = {r.rule_id: r.fixes for r in reports.fixes_by_rule(outcomes).collect()}
    return FixResult(outcomes.drop("messages", "rejected", "prompt_len", "kept", "tools"), lines, counts, by_rule, [f"{r.error} ({r.n} records, first on line {r.line_no})" for r in troubles])


def report(spark: SparkSession, paths: list[str] | str, shape: str = "auto", max_seq_len: int = MAX_SEQ_LEN, baseline: dict | None = None) -> dict:
    """One document of aggregates, with the regressions against an earlier document where one is given."""
    result = check(spark, paths, shape, max_seq_len=max_seq_len)
    whole = result.records.where("parse_error is null")
    rows = lambda df: [r.asDict() for r in df.collect()]
    total = max(result.total, 1)
    lines = result.findings.agg(*(F.count_distinct(F.when(F.col("severity") == s, F.struct("file", "line_no"))).alias(s) for s in SEVERITY_RANK)).first()
    copies = reports.duplicate_stats(whole).agg(F.sum("redundant").alias("n")).first().n or 0
    rates = {"clean_fraction": result.valid / total, "error_rate": lines[ERROR] / total, "warning_rate": lines[WARNING] / total, "duplicate_rate": copies / total, "unparseable_rate": result.records.where("parse_error is not null").count() / total}
    out = {
        "schema_version": SCHEMA_VERSION, "total": result.total, "valid": result.valid, "by_rule": result.counts, "formats": rows(reports.by_format(whole)), "roles": rows(reports.role_histogram(whole)),
        "turns": rows(reports.turn_stats(whole)), "tokens": rows(reports.token_stats(whole, max_seq_len)), "duplicates": rows(reports.duplicate_stats(whole)), "rates": rates, "exit_code": result.exit_code,
    }
    if baseline is not None:
        before = baseline.get("rates")
        worse = [] if before else ["the baseline has no rates"]
        for name, value in rates.items():
            if before and name in before and ((value < before[name] - 1e-9) if name == "clean_fraction" else (value > before[name] + 1e-9)):
                worse.append(f"{name}: {before[name]:.4f} to {value:.4f}")
        out["regressions"] = worse
        out["exit_code"] = 3 if worse else out["exit_code"]
    return out


def rule_list() -> list[dict]:
    return [r._asdict() for r in RULES.values()]


def markdown(summary: dict) -> str:
    """A report as a Markdown table; text of the data is fenced by more ticks than it holds."""
    head = [f"# {summary['valid']} of {summary['total']} records without errors", "", "| rule | errors | warnings |", "|---|---|---|"]
    body = [f"| {c['rule_id']} | {c['errors']} | {c['warnings']} |" for c in summary["by_rule"]]
    roles = json.dumps({r["role"]: r["messages"] for r in summary["roles"]}, ensure_ascii=False)
    ticks = "`" * (max((len(x) for x in roles.split("`") if not x), default=0) + 3)
    return "\n".join([*head, *body, "", ticks, roles, ticks])
