"""Repairs of canonical records, and what became of each line."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions import pii, secrets
from loomsift.functions.text import BOM, approximate_tokens, garbled_marker, repaired, strip
from loomsift.operators import mending, rules
from loomsift.operators import records as rec
from loomsift.schema import EMPTY_CALLS, MAX_SEQ_LEN, ROLES
from loomsift.session import written


def map_texts(records: DataFrame, change) -> DataFrame:
    """The records with ``change`` applied to every message text."""
    one = lambda c: F.transform(c, lambda m: rec.message(m["role"], change(m["content"])))
    return records.withColumns({"messages": one("messages"), "rejected": one("rejected")})


def repair_encoding(records: DataFrame) -> DataFrame:
    """Byte order marks removed and garbled sequences replaced."""
    return map_texts(records, repaired)


def redact_secrets(records: DataFrame) -> DataFrame:
    """Credentials in message texts replaced at their places."""
    return _changed_texts(records, secrets.HINT, secrets.redact)


def redact_pii(records: DataFrame) -> DataFrame:
    """Personal data in message texts replaced at their places."""
    return _changed_texts(records, f"@|{pii.DIGITS}", pii.redact)


def _changed_texts(records: DataFrame, hint: str, change: Callable[[str], str]) -> DataFrame:
    """Texts changed in Python; only sides with a text that has the hint leave the JVM."""

    @F.pandas_udf("array<string>")
    def run(sides: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else [t if t is None else change(t) for t in s] for s in sides], dtype=object)

    def one(side: str) -> tuple[Column, Column]:
        texts = F.transform(side, lambda m: m["content"])
        new = run(F.when(F.exists(side, lambda m: m["content"].rlike(hint)), texts))
        put = F.transform(side, lambda m, i: rec.message(m["role"], F.get(F.col(f"_{side}"), i)))
        return new, F.when(F.col(f"_{side}").isNotNull(), put).otherwise(F.col(side))

    sides = {side: one(side) for side in ("messages", "rejected")}
    held = records.withColumns({f"_{side}": new for side, (new, _) in sides.items()})
    return held.withColumns({side: put for side, (_, put) in sides.items()}).drop("_messages", "_rejected")


def drop_empty(records: DataFrame) -> DataFrame:
    """Messages of nothing but white space removed; messages becomes null where a side would be left empty."""
    full = lambda m: m["content"].isNull() | (strip(m["content"]) != "")
    kept = records.withColumns(
        {"messages": F.filter("messages", full), "rejected": F.filter("rejected", full), "prompt_len": F.when(F.col("prompt_len").isNotNull(), F.size(F.filter(F.slice("messages", F.lit(1), F.coalesce("prompt_len", F.lit(0))), full)))}
    )
    broken = (F.size("messages") == 0) | (F.col("rejected").isNotNull() & (F.size("rejected") == 0))
    return kept.withColumn("messages", F.when(~broken, F.col("messages")))


def truncate_longest(records: DataFrame, max_seq_len: int = MAX_SEQ_LEN, rounds: int = 20) -> DataFrame:
    """The longest user message cut to four fifths until the record fits; null messages where it never does.

    A cut of c characters to int(c * 0.8) is repeated at most ``rounds`` times, always on the message
    that is longest then, the first among equals.
    """
    user = lambda m: m["role"] == "user"
    longest = lambda ms: F.array_max(F.transform(F.filter(ms, user), lambda m: F.coalesce(F.length(m["content"]), F.lit(0))))

    def cut(ms: Column) -> Column:
        top = longest(ms)
        at = F.array_position(F.transform(ms, lambda m: user(m) & (F.length(m["content"]) == top)), F.lit(True)) - 1
        return F.transform(ms, lambda m, i: F.when(i == at, rec.message(m["role"], F.substring(m["content"], F.lit(1), F.floor(F.length(m["content"]) * 0.8).cast("int")))).otherwise(m))

    step = lambda ms, _: F.when((rules.side_tokens(ms) > max_seq_len) & (F.coalesce(longest(ms), F.lit(0)) > 0), cut(ms)).otherwise(ms)
    over = rules.side_tokens(F.col("messages")) > max_seq_len
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("messages"), step)
    fitted = records.withColumn("messages", F.when(over, done).otherwise(F.col("messages")))
    return fitted.withColumn("messages", F.when(rules.side_tokens(F.col("messages")) <= max_seq_len, F.col("messages")))


def deduplicated(records: DataFrame) -> DataFrame:
    """The first line of each content."""
    again = rules.duplicates(records).select("file", "line_no")
    return records.join(again, ["file", "line_no"], "left_anti")


def without_overlap(records: DataFrame, held_out: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """Records that match nothing held out, neither now nor, where ``original`` is given, before repair."""
    hits = rules.overlap(records, held_out).select("file", "line_no")
    if original is not None:
        hits = hits.unionByName(rules.overlap(original, held_out).select("file", "line_no")).distinct()
    return records.join(hits, ["file", "line_no"], "left_anti")


FIXED = f"file string, line_no bigint, disposition string, rules_fixed array<string>, rules_unfixable array<string>, error string, messages {rec.MESSAGES}, rejected {rec.MESSAGES}, prompt_len int, kept array<int>, tools {rec.BEYOND['tools']}"


def suspect(max_seq_len: int = MAX_SEQ_LEN) -> Column:
    """Whether a rule over the record or a message of it may find something; false means that none does."""
    said = rec.slot_array()
    hint = lambda m: (
        ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)) | m["content"].isNull() | (strip(m["content"]) == "") | F.contains(m["content"], F.lit(BOM))
        | garbled_marker(m["content"]).isNotNull() | secrets.hint(m["content"]) | pii.hint(m["content"])
    )
    whole = F.concat(rules.schema(), rules.roles(), rules.context_window(max_seq_len), rules.preference())
    return (F.size(whole) > 0) | F.col("tools").isNotNull() | (F.coalesce(F.size("fields"), F.lit(0)) > 0) | F.exists(said, hint)


def _mend(off: frozenset[str], max_seq_len: int):
    kinds = ("disposition", "rules_fixed", "rules_unfixable", "error", "messages", "rejected", "prompt_len", "kept", "tools")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b in batches:
            out = []
            for r in b.to_pylist():
                m = mending.mended(r, off, max_seq_len)
                m["disposition"] = "dropped" if m["messages"] is None else "fixed" if m["rules_fixed"] else "unchanged"
                out.append({"file": r["file"], "line_no": r["line_no"]} | {k: m.get(k, r.get(k)) for k in kinds})
            schema = schema or _arrow_schema(b.schema)
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _arrow_schema(source: pa.Schema) -> pa.Schema:
    text, texts = pa.string(), pa.list_(pa.string())
    own = {"disposition": text, "rules_fixed": texts, "rules_unfixable": texts, "error": text, "kept": pa.list_(pa.int32())}
    names = ("file", "line_no", "disposition", "rules_fixed", "rules_unfixable", "error", "messages", "rejected", "prompt_len", "kept", "tools")
    return pa.schema([(n, own[n] if n in own else source.field(n).type) for n in names])


def fixed(records: DataFrame, held_out: DataFrame | None = None, disabled: set[str] | None = None, max_seq_len: int = MAX_SEQ_LEN) -> DataFrame:
    """What becomes of every record, in the columns of ``FIXED``; messages is null where the record is lost.

    Records that no rule may object to stay in the JVM. The others are repaired to a fixed point and validated
    again (see operators.mending); then duplicates and overlaps among what is left are dropped, named by their rule.
    """
    off = frozenset(disabled or ())
    rows = rec.whole(records).withColumn("suspect", F.coalesce(suspect(max_seq_len), F.lit(True)))
    if "tool_errors" in rows.columns:
        rows = rows.withColumn("tool_faulty", F.exists("tool_errors", lambda e: e != EMPTY_CALLS))
    else:
        rows = rows.withColumn("tool_faulty", F.lit(False))
    rows = rows.withColumn("suspect", F.col("suspect") | F.col("tool_faulty"))
    rows = rows.select("file", "line_no", "messages", "rejected", "prompt_len", "tools", "fields", "tool_faulty", "suspect")
    none = F.array().cast("array<string>")
    plain = rows.where("not suspect").select(
        "file", "line_no", F.lit("unchanged").alias("disposition"), none.alias("rules_fixed"), none.alias("rules_unfixable"), F.lit(None).cast("string").alias("error"),
        "messages", "rejected", "prompt_len", F.sequence(F.lit(0), F.size("messages") - 1).alias("kept"), "tools",
    )
    mended = rows.where("suspect").drop("suspect").mapInArrow(_mend(off, max_seq_len), FIXED)
    state = written(plain.unionByName(mended), "fix-state")  # read by every branch below
    rest = state.where("messages is not null")
    by = F.lit(None).cast("string")
    judged = state
    if "duplicates" not in off:
        again = rules.duplicates(rest).select("file", "line_no", F.lit(True).alias("again"))
        judged = judged.join(again, ["file", "line_no"], "left")
        by = F.when(F.col("again"), "duplicates")
    if held_out is not None and "eval-overlap" not in off:
        hits = rules.overlap(rest, held_out).unionByName(rules.overlap(records, held_out)).select("file", "line_no").distinct()
        judged = judged.join(hits.withColumn("hit", F.lit(True)), ["file", "line_no"], "left")
        by = F.coalesce(by, F.when(F.col("hit"), "eval-overlap"))
    gone = F.col("messages").isNotNull() & by.isNotNull()
    changed = {"disposition": F.when(gone, "dropped").otherwise(F.col("disposition")), "rules_fixed": F.when(gone, F.concat("rules_fixed", F.array(by))).otherwise(F.col("rules_fixed"))}
    changed |= {c: F.when(~gone, F.col(c)) for c in ("messages", "rejected", "prompt_len", "kept")}
    return judged.withColumns(changed).select("file", "line_no", "disposition", "rules_fixed", "rules_unfixable", "error", "messages", "rejected", "prompt_len", "kept", "tools")


def planner_tokens(messages: Column) -> Column:
    """The planner's estimate: text and overhead of each message, without role tags."""
    return F.aggregate(F.transform(messages, lambda m: approximate_tokens(F.coalesce(m["content"], F.lit(""))) + 4), F.lit(0).cast("bigint"), lambda a, x: a + x)
