"""Validation rules as column expressions over canonical records.

Findings are rows (file, line_no, rule_id, severity, idx, kind); idx is the message a finding is
about, or null. Rules over a record or a message are arrays of findings that are computed and
exploded without a shuffle; duplicates and overlap aggregate by hash before they join, so a hot
key is combined in place first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsift.functions import pii as pii_text
from loomsift.functions import secrets as secret_text
from loomsift.functions.text import BOM, bound, garbled_marker, message_tokens, strip
from loomsift.operators import records as rec
from loomsift.schema import ERROR, MAX_SEQ_LEN, ROLES, RULES, WARNING
from loomsift.session import written


def _finding(rule: str, severity: str, idx: Column | None, kind: Column | str) -> Column:
    """A finding as one string, its parts told apart by a control character: arrays of them stay flat."""
    place = F.lit("") if idx is None else F.coalesce(idx.cast("string"), F.lit(""))
    return F.concat_ws("\x01", F.lit(f"{rule}\x01{severity}"), place, F.lit(kind) if isinstance(kind, str) else kind)


def _parts(finding: Column) -> list[Column]:
    part = lambda n: F.get(F.split(finding, "\x01"), F.lit(n))
    return [part(0).alias("rule_id"), part(1).alias("severity"), F.when(part(2) != "", part(2).cast("bigint")).alias("idx"), part(3).alias("kind")]


def _none() -> Column:
    return F.array().cast("array<string>")


def schema() -> Column:
    """A record without messages."""
    missing = F.col("messages").isNull() | (F.size("messages") == 0)
    return F.when(missing, F.array(_finding("schema", ERROR, None, "no messages"))).otherwise(_none())


def message_schema() -> Column:
    """An unknown or missing role, a missing text; a call of a tool needs none."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), _finding("schema", ERROR, F.col("idx"), "invalid role")),
        F.when(F.col("content").isNull() & ~F.col("calls"), _finding("schema", ERROR, F.col("idx"), "no content")),
    ))


def _other_side() -> Column:
    """The rejected conversation: the prompt and the rejected continuation."""
    return F.when(F.col("rejected").isNotNull(), F.concat(F.slice("messages", F.lit(1), F.coalesce("prompt_len", F.lit(0))), F.col("rejected")))


def _role_order(turns: Column) -> Column:
    """Turn order of one conversation: system first, user and assistant in turn, the assistant last."""
    numbered = F.transform(turns, lambda m, i: F.struct(i.alias("idx"), m["role"].alias("role")))

    def judge(known: Column) -> Column:
        """``known``: the turns before the first without a role, and whether there is such a one."""
        every = known["turns"]

        def order(said: Column) -> Column:
            before = lambda i: F.get(said, i - 1)["role"]
            expected = lambda i: F.when(i == 0, "user").when(before(i) == "user", "assistant").otherwise("user")
            first = lambda m: (m["idx"] == 0) | ((m["idx"] == 1) & (F.get(every, F.lit(0))["role"] == "system"))
            return F.transform(said, lambda m, i: F.when(m["role"] != expected(i), _finding("roles", ERROR, m["idx"], F.when(first(m), "first role").otherwise("alternation"))))

        late = F.transform(F.filter(every, lambda m: (m["role"] == "system") & (m["idx"] > 0)), lambda m: _finding("roles", ERROR, m["idx"], "late system"))
        last = F.element_at(every, -1)
        end = F.when(~known["cut"] & (last["role"] != "assistant"), _finding("roles", ERROR, last["idx"], "ends on other"))
        return F.array_compact(F.concat(bound(F.filter(every, lambda m: m["role"] != "system"), order), late, F.array(end)))

    def cut(turns: Column) -> Column:
        stop = F.coalesce(F.array_position(F.transform(turns, lambda m: F.coalesce(m["role"], F.lit(""))), ""), F.lit(0))
        return bound(stop, lambda n: F.struct(F.when(n > 0, F.slice(turns, F.lit(1), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(turns).alias("turns"), (n > 0).alias("cut")))

    found = bound(bound(numbered, cut), judge)
    return F.when(turns.isNotNull() & (F.size(turns) > 0), found).otherwise(_none())


def roles() -> Column:
    """Turn order of each side. A null role ends the check. Tool turns are judged where they are parsed."""
    plain = F.concat(_role_order(F.col("messages")), bound(_other_side(), _role_order))
    return F.when(F.col("tools").isNull(), plain).otherwise(F.transform("tools.roles", lambda r: _finding("roles", ERROR, r["idx"], r["kind"])))


def empty_content() -> Column:
    """A message of nothing but white space."""
    return F.when(F.col("content").isNotNull() & ~F.col("calls") & (strip(F.col("content")) == ""), F.array(_finding("empty-content", ERROR, F.col("idx"), "empty")))


def side_tokens(turns: Column) -> Column:
    return F.aggregate(F.transform(turns, lambda m: message_tokens(m["role"], m["content"])), F.lit(0).cast("bigint"), lambda a, x: a + x)


def longest_side() -> Column:
    """Estimated tokens of the longer side of a record, tool calls and definitions included."""
    return F.coalesce(F.col("tools.tokens"), F.greatest(side_tokens(F.col("messages")), bound(_other_side(), side_tokens)))


def record_tokens(records: DataFrame) -> DataFrame:
    """(file, line_no, tokens) of each record that has messages."""
    return rec.whole(records).where(F.col("messages").isNotNull()).select("file", "line_no", longest_side().alias("tokens"))


def context_window(max_seq_len: int = MAX_SEQ_LEN) -> Column:
    """Records whose estimate is over the window."""
    return F.when(longest_side() > max_seq_len, F.array(_finding("context-window", WARNING, None, "too long"))).otherwise(_none())


def encoding() -> Column:
    """Byte order marks, and one finding for each message with a garbled sequence."""
    return F.array_compact(F.array(
        F.when(F.contains("content", F.lit(BOM)), _finding("encoding", WARNING, F.col("idx"), "byte order mark")),
        F.when(garbled_marker(F.col("content")).isNotNull(), _finding("encoding", WARNING, F.col("idx"), "garbled")),
    ))


def preference() -> Column:
    """Pairs whose sides say the same."""
    plain = lambda c: F.transform(c, lambda m: F.struct(m["role"].alias("role"), strip(m["content"]).alias("content")))
    chosen = F.slice("messages", F.coalesce("prompt_len", F.lit(0)) + 1, F.size("messages"))
    same = F.col("rejected").isNotNull() & bound(chosen, lambda c: (F.size(c) > 0) & (plain(c) == plain(F.col("rejected"))))
    return F.when(same, F.array(_finding("preference", ERROR, None, "identical sides"))).otherwise(_none())


def secrets() -> Column:
    """Credentials in message texts."""
    return F.transform(secret_text.found(F.col("content")), lambda s: _finding("secrets", ERROR, F.col("idx"), s["kind"]))


def pii() -> Column:
    """Personal data in message texts."""
    return F.transform(pii_text.found(F.col("content")), lambda s: _finding("pii", WARNING, F.col("idx"), s["kind"]))


def in_fields(names: list[str]) -> Column:
    """Credentials and personal data outside the message texts, as the parser found them."""
    severity = lambda f: F.when(f["rule"] == "secrets", ERROR).otherwise(WARNING)
    named = F.filter("fields", lambda f: f["rule"].isin(names))
    return F.transform(named, lambda f: F.concat_ws("\x01", f["rule"], severity(f), F.lit(""), f["kind"]))


#: Rules over a whole record, as arrays over ``messages``, ``rejected``, ``prompt_len``, ``tools`` and ``fields``.
RECORD_RULES = {"schema": schema, "roles": roles, "context-window": context_window, "preference": preference}
#: Rules over one message, as arrays over ``idx``, ``role``, ``content`` and ``calls``.
MESSAGE_RULES = {"schema": message_schema, "empty-content": empty_content, "encoding": encoding, "secrets": secrets, "pii": pii}
STATELESS = (*RECORD_RULES, *(n for n in MESSAGE_RULES if n not in RECORD_RULES))


def _together(arrays: list[Column]) -> Column:
    return F.concat(*(F.coalesce(a, _none()) for a in arrays)) if arrays else _none()


def scanned(records: DataFrame, names: list[str], max_seq_len: int = MAX_SEQ_LEN, *keep: str) -> DataFrame:
    """(file, line_no, *keep, found): one pass over the records. The first row of each carries what the whole record
    gives rise to, the others what a message of it does; ``keep`` stands in the first only, the others have null there."""
    of_record = [RECORD_RULES[n](max_seq_len) if n == "context-window" else RECORD_RULES[n]() for n in names if n in RECORD_RULES]
    if inside := [n for n in ("secrets", "pii") if n in names]:
        of_record.append(in_fields(inside))
    whole = rec.whole(records).withColumn("of_record", _together(of_record))
    each = whole.select("file", "line_no", *keep, "of_record", F.explode(F.concat(F.array(rec.slot(None, None)), rec.slot_array())).alias("s"))
    first = F.col("s.side").isNull()
    kept = [F.when(first, F.col(c)).alias(c) for c in keep]
    rows = each.select("file", "line_no", *kept, F.when(first, F.col("of_record")).alias("of_record"), first.alias("first"), "s.idx", "s.role", "s.content", "s.calls")
    of_message = _together([MESSAGE_RULES[n]() for n in names if n in MESSAGE_RULES])
    return rows.select("file", "line_no", *keep, "first", F.when(F.col("first"), F.col("of_record")).otherwise(of_message).alias("found"))


def _exploded(found: DataFrame) -> DataFrame:
    return found.select("file", "line_no", F.explode("found").alias("f")).select("file", "line_no", *_parts(F.col("f")))


def record_findings(records: DataFrame, names: list[str] | None = None, max_seq_len: int = MAX_SEQ_LEN) -> DataFrame:
    """(file, line_no, rule_id, severity, idx, kind): the findings of the named rules that need no other record.

    One pass over the records serves all rules.
    """
    return _exploded(scanned(records, [n for n in STATELESS if names is None or n in names], max_seq_len))


def content_key(records: DataFrame) -> DataFrame:
    """The records with ``full_key`` (null messages count as no messages) and ``prompt_key`` (null without a prompt)."""
    part = lambda m: F.concat(F.coalesce(m["role"], F.lit("\x00")), F.lit("\x01"), F.coalesce(strip(m["content"]), F.lit("\x00")), F.lit("\x02"))
    none = F.array().cast(rec.MESSAGES)
    text = lambda c: F.array_join(F.transform(F.coalesce(c, none), part), "")
    pair = F.when(F.col("rejected").isNotNull(), F.concat(F.lit("\x03"), F.col("prompt_len").cast("string"), F.lit("\x03"), text(F.col("rejected")))).otherwise(F.lit(""))
    end = rec.prompt_end(F.col("messages"), F.col("prompt_len"))
    prompt = F.slice("messages", F.lit(1), end)
    beyond = lambda name: F.coalesce(F.col(f"tools.{name}"), F.lit(""))
    full = F.sha2(F.concat(text(F.col("messages")), pair, beyond("key")), 256)
    asked = F.sha2(F.concat(text(prompt), beyond("prompt_key")), 256)
    return rec.whole(records).withColumns({"full_key": full, "prompt_key": F.when(F.col("messages").isNotNull() & (F.size(prompt) > 0), asked)})


def repeats(keyed: DataFrame) -> DataFrame:
    """(file, line_no, first_line) of the rows of (file, line_no, full_key) whose content stands on an earlier line.

    Contents are counted by key first; only those that occur more than once are joined.
    """
    counts = keyed.groupBy("file", "full_key").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(counts, ["file", "full_key"]).where("line_no > first_line").select("file", "line_no", "first_line")


def _keys(records: DataFrame) -> DataFrame:
    return content_key(records).select("file", "line_no", "full_key")


def _dataset_finding(rows: DataFrame, rule: str, kind: Column | str) -> DataFrame:
    return rows.select("file", "line_no", *_parts(_finding(rule, ERROR, None, kind)))


def duplicates(records: DataFrame) -> DataFrame:
    """Records that repeat an earlier line of their file."""
    return _dataset_finding(repeats(_keys(records)), "duplicates", "duplicate")


def overlap(training: DataFrame, held_out: DataFrame) -> DataFrame:
    """(file, line_no, match, eval_line): training records that stand in the evaluation set, whole or by their prompt.

    A whole match wins over one of the prompt; the first evaluation line is named.
    """
    own, other = content_key(training), content_key(held_out)
    full = other.groupBy("full_key").agg(F.min("line_no").alias("full_line"))
    prompt = other.where("prompt_key is not null").groupBy("prompt_key").agg(F.min("line_no").alias("prompt_line"))
    joined = own.select("file", "line_no", "full_key", "prompt_key").join(full, "full_key", "left").join(prompt, "prompt_key", "left")
    hit = joined.where(F.col("full_line").isNotNull() | F.col("prompt_line").isNotNull())
    return hit.select("file", "line_no", F.when(F.col("full_line").isNotNull(), "full").otherwise("prompt").alias("match"), F.coalesce("full_line", "prompt_line").alias("eval_line"))


def eval_overlap(training: DataFrame, held_out: DataFrame) -> DataFrame:
    return _dataset_finding(overlap(training, held_out), "eval-overlap", F.col("match"))


def findings(records: DataFrame, disabled: set[str] | None = None, held_out: DataFrame | None = None, max_seq_len: int = MAX_SEQ_LEN) -> DataFrame:
    """The findings of every enabled rule, with the rule's place in ``rule_order``.

    The records are read once: one pass makes the findings of the record rules and the content keys, which are
    written to the shared folder and serve duplicates from there.
    """
    off = disabled or set()
    names = [n for n in STATELESS if n not in off]
    if "duplicates" in off:
        out = record_findings(records, names, max_seq_len)
    else:
        once = scanned(content_key(records), names, max_seq_len, "full_key").where(F.col("first") | (F.size("found") > 0))
        once = written(once, "scan")
        again = _dataset_finding(repeats(once.where("first").select("file", "line_no", "full_key")), "duplicates", "duplicate")
        out = _exploded(once).unionByName(again)
    if held_out is not None and "eval-overlap" not in off:
        out = out.unionByName(eval_overlap(records, held_out))
    order = F.create_map(*(F.lit(x) for r in RULES.values() for x in (r.id, r.order)))
    return out.withColumn("rule_order", order[F.col("rule_id")])
