"""Canonical records from tables of the four record shapes.

One row is (file, line_no, source_format, split, messages, rejected, prompt_len): messages is
an array of (role, content); rejected holds only the rejected continuation of a pair, whose
prompt is the first prompt_len messages. A record that its shape cannot fill, such as an
instruction record without output, has null messages. Other columns of the tables are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsift.sources.tables import table

MESSAGES = "array<struct<role:string,content:string>>"
#: What JSON lines have beyond (role, content): tool turns (see sources.turns), and findings in other fields.
BEYOND = {
    "tools": "struct<roles:array<struct<idx:bigint,kind:string>>,calls:array<int>,rejected_calls:array<int>,key:string,prompt_key:string,tokens:bigint>",
    "fields": "array<struct<rule:string,kind:string>>",
}
#: Speakers of turn-based records and the roles they stand for; others pass through. Fixed values.
SPEAKERS = {"human": "user", "user": "user", "gpt": "assistant", "chatgpt": "assistant", "bard": "assistant", "assistant": "assistant", "system": "system", "tool": "tool", "function": "tool", "observation": "tool"}


def whole(records: DataFrame) -> DataFrame:
    """The records with null ``tools`` and ``fields`` where they have no such columns."""
    return records.withColumns({name: F.lit(None).cast(kind) for name, kind in BEYOND.items() if name not in records.columns})


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def _row(df: DataFrame, file: str, shape: str, split: Column | None, messages: Column, rejected: Column | None = None, prompt_len: Column | None = None) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return df.select(
        F.lit(file).alias("file"), "line_no", F.lit(shape).alias("source_format"), (split if split is not None else none("string")).alias("split"), messages.cast(MESSAGES).alias("messages"),
        (rejected if rejected is not None else none(MESSAGES)).cast(MESSAGES).alias("rejected"), (prompt_len if prompt_len is not None else none("int")).cast("int").alias("prompt_len"),
    )


def chat(df: DataFrame, file: str = "clean") -> DataFrame:
    """Chat records: messages as they are."""
    return _row(df, file, "openai-chat", F.col("split") if "split" in df.columns else None, F.transform("messages", lambda m: message(m["role"], m["content"])))


def turns(df: DataFrame, file: str = "sharegpt_clean") -> DataFrame:
    """Turn-based records: speakers become roles."""
    known = F.create_map(*(F.lit(x) for kv in SPEAKERS.items() for x in kv))
    return _row(df, file, "sharegpt", None, F.transform("conversations", lambda t: message(F.coalesce(known[t["from"]], t["from"]), t["value"])))


def instructions(df: DataFrame, file: str = "alpaca_clean") -> DataFrame:
    """Instruction records: system, history, instruction with its input, output."""
    none = F.array().cast(MESSAGES)
    head = F.when(F.col("system") != "", F.array(message("system", F.col("system")))).otherwise(none)
    past = F.coalesce(F.flatten(F.transform("history", lambda h: F.array(message("user", F.get(h, F.lit(0))), message("assistant", F.get(h, F.lit(1)))))), none)
    asked = F.when(F.col("input") != "", F.concat("instruction", F.lit("\n\n"), "input")).otherwise(F.col("instruction"))
    whole = F.concat(head, past, F.array(message("user", asked), message("assistant", F.col("output"))))
    return _row(df, file, "alpaca", F.col("split") if "split" in df.columns else None, F.when(F.col("instruction").isNotNull() & F.col("output").isNotNull(), whole))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading messages two arrays share, leaving at least one of each."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"].eqNullSafe(z["b"]))
    first = F.coalesce(F.array_position(same, F.lit(False)), F.lit(0))
    n = F.when(first > 0, first - 1).otherwise(F.size(same))
    return F.greatest(F.lit(0), F.least(n, F.size(a) - 1, F.size(b) - 1)).cast("int")


def preferences(df: DataFrame, file: str = "preference_clean") -> DataFrame:
    """Preference records: with a prompt both sides are answers, without one both are whole conversations as JSON text."""
    told = F.col("prompt").isNotNull()
    side = lambda c: F.when(told & F.col(c).isNotNull(), F.array(message("assistant", F.col(c)))).when(~told, F.from_json(F.col(c), MESSAGES))
    both = df.select("line_no", "prompt", side("chosen").alias("a"), side("rejected").alias("b"))
    ready = F.col("a").isNotNull() & F.col("b").isNotNull()
    n = F.when(told, F.lit(1)).otherwise(shared_prefix(F.col("a"), F.col("b")))
    messages = F.when(told, F.concat(F.array(message("user", F.col("prompt"))), F.col("a"))).otherwise(F.col("a"))
    rest = F.when(told, F.col("b")).otherwise(F.slice("b", n + 1, F.size("b")))
    return _row(both, file, "preference", None, F.when(ready, messages), F.when(ready, rest), F.when(ready, n))


def all_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all four tables of a data folder."""
    parts = (chat(table(spark, folder, "clean")), turns(table(spark, folder, "sharegpt_clean")), instructions(table(spark, folder, "alpaca_clean")), preferences(table(spark, folder, "preference_clean")))
    return reduce(DataFrame.unionByName, parts)


def completion_start(messages: Column) -> Column:
    """Index at which the closing run of assistant messages begins."""
    backwards = F.transform(F.reverse(messages), lambda m: m["role"].eqNullSafe(F.lit("assistant")))
    stop = F.coalesce(F.array_position(backwards, F.lit(False)), F.lit(0))
    return F.when(stop > 0, F.size(messages) - (stop - 1)).otherwise(F.lit(0)).cast("int")


def prompt_end(messages: Column, prompt_len: Column) -> Column:
    return F.coalesce(prompt_len, completion_start(messages))


def sides(records: DataFrame) -> DataFrame:
    """(file, line_no, side, turns): each conversation of a record, the rejected one with its prompt."""
    both = F.array(
        F.struct(F.lit("").alias("side"), F.col("messages").alias("turns")),
        F.struct(F.lit("rejected").alias("side"), F.when(F.col("rejected").isNotNull(), F.concat(F.slice("messages", F.lit(1), F.coalesce("prompt_len", F.lit(0))), F.col("rejected"))).alias("turns")),
    )
    each = records.select("file", "line_no", F.explode(F.filter(both, lambda s: s["turns"].isNotNull())).alias("s"))
    return each.select("file", "line_no", "s.side", "s.turns")


SLOT = "struct<side:string,idx:bigint,role:string,content:string,calls:boolean>"


def slot(side: str | None, idx: Column | None, role: Column | None = None, content: Column | None = None, calls: Column | None = None) -> Column:
    parts = {"side": F.lit(side), "idx": idx, "role": role, "content": content, "calls": calls}
    return F.struct(*((F.lit(None) if c is None else c).alias(name) for name, c in parts.items())).cast(SLOT)


def slot_array() -> Column:
    """Every message of a record once, of either side; ``calls`` marks a turn that calls a tool."""
    def side(name: str, turns: str, calls: str) -> Column:
        called = lambda i: F.coalesce(F.array_contains(F.col(calls), i), F.lit(False))
        return F.coalesce(F.transform(turns, lambda m, i: slot(name, i, m["role"], m["content"], called(i))), F.array().cast(f"array<{SLOT}>"))

    return F.concat(side("", "messages", "tools.calls"), side("rejected", "rejected", "tools.rejected_calls"))


def slots(records: DataFrame) -> DataFrame:
    """(file, line_no, side, idx, role, content): every message once."""
    each = whole(records).select("file", "line_no", F.explode(slot_array()).alias("s"))
    return each.select("file", "line_no", "s.side", "s.idx", "s.role", "s.content")
