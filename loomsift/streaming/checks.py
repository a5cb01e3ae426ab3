"""Record rules and exact dedupe over a stream of JSON lines or of canonical records.

Record rules keep no state, so they run on a stream as they do on a table. Copies are dropped
within a watermark, which bounds the state; the whole table's duplicates stay a batch rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.operators import rules
from loomsift.schema import MAX_SEQ_LEN
from loomsift.sources import jsonl


def parsed_stream(lines: DataFrame, shape: str = "auto") -> DataFrame:
    """Canonical records of a stream of (file, line_no, raw)."""
    return jsonl.parse(lines, shape)


def stream_findings(records: DataFrame, names: list[str] | None = None, max_seq_len: int = MAX_SEQ_LEN) -> DataFrame:
    """Findings of the record rules."""
    return rules.record_findings(records, names, max_seq_len)


def stream_deduplicated(records: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first of each content that arrives within the delay."""
    keyed = rules.content_key(records).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["file", "full_key"]).drop("full_key", "prompt_key")


def finding_counts(findings: DataFrame, time: str, delay: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Findings by rule in windows of time; late rows beyond the delay are left out."""
    return findings.withWatermark(time, delay).groupBy(F.window(time, width), "rule_id").agg(F.count("*").alias("findings"))
