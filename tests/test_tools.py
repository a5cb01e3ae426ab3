"""Tool turns, strings outside messages, and redaction by place."""

from __future__ import annotations

import json
import random

import pytest

from loomsift.functions import pii, secrets
from loomsift.operators import mending, repair, rules
from loomsift.operators import records as rec
from loomsift.plans import api
from loomsift.sources import jsonl, turns

KEY = "ghp_" + "a1" * 18


def call(name="f", key=None, arguments="{}"):
    return {"type": "function", "function": {"name": name, "arguments": arguments}} | ({"id": key} if key else {})


def said(*messages):
    """Turns as r, r:key (a reply) or r!key,key (calls)."""
    out = []
    for m in messages:
        role, _, keys = m.partition("!")
        role, _, reply = role.partition(":")
        turn = {"role": role, "content": None if keys else "x"}
        if keys:
            turn["tool_calls"] = [call(key=None if k == "-" else k) for k in keys.split(",")]
        if reply and reply != "-":
            turn["tool_call_id"] = reply
        out.append(turn)
    return out


@pytest.mark.parametrize(
    ("messages", "faults"),
    [
        (["user", "assistant!a", "tool:a", "assistant"], []),
        (["user", "assistant!a,b", "tool:b", "tool:a", "assistant"], []),
        (["user", "assistant!-,-", "tool:-", "tool:-", "user", "assistant"], []),
        (["user", "assistant!a"], []),  # a call may end the record
        (["user", "assistant!a", "assistant"], [(1, "call never answered")]),
        (["user", "assistant!a", "user", "assistant"], [(1, "call never answered"), (2, "alternation")]),
        (["user", "assistant!a", "tool:b", "assistant"], [(1, "call never answered"), (2, "reply without a call")]),
        (["user", "assistant!a,b", "tool:a", "tool:a", "tool:b", "assistant"], [(3, "call already answered")]),
        (["user", "assistant!a", "tool:-", "tool:a", "assistant"], [(2, "reply without the id of its call")]),
        (["user", "tool:-", "assistant"], [(1, "reply without a call")]),
        (["user", "assistant!a", "tool:a"], [(2, "ends on other")]),
        (["system", "assistant"], [(1, "first role")]),
    ],
)
def test_exchanges(messages, faults):
    assert sorted(turns.role_faults(said(*messages))) == faults


def test_calls_in_text_and_old_functions():
    written = [{"role": "user", "content": "x"}, {"role": "assistant", "content": '<tool_call>{"name": "f"}</tool_call>'}, {"role": "tool", "content": "1"}, {"role": "tool", "content": "2"}, {"role": "assistant", "content": "y"}]
    assert turns.role_faults(written) == []
    old = [{"role": "user", "content": "x"}, {"role": "assistant", "content": None, "function_call": {"name": "f", "arguments": "{}"}}, {"role": "function", "name": "f", "content": "1"}, {"role": "assistant", "content": "y"}]
    assert turns.role_faults(old) == []
    assert turns.role_faults([old[0], old[1], {**old[2], "name": "g"}, old[3]]) == [(2, "function reply without a call"), (1, "function call never answered")]


SHARE = {
    "conversations": [{"from": "human", "value": "q"}, {"from": "function_call", "value": '{"name": "f", "arguments": {"a": 1}}'}, {"from": "observation", "value": "3"}, {"from": "gpt", "value": "cafÃ©"}],
    "tools": '[{"name": "f", "parameters": {}}]',
}


def test_turn_based_calls():
    p = jsonl.parse_line(json.dumps(SHARE))
    assert p["tool_errors"] == [] and p["tools"]["roles"] == [] and p["tools"]["calls"] == [1]
    assert [m["role"] for m in p["messages"]] == ["user", "assistant", "tool", "assistant"]


def test_tools_in_keys_and_sizes():
    plain = {"messages": said("user", "assistant")}
    declared = plain | {"tools": [{"type": "function", "function": {"name": "f", "parameters": {}}}]}
    a, b = jsonl.parse_line(json.dumps(plain)), jsonl.parse_line(json.dumps(declared))
    declared_size = -(-len(json.dumps({"tools": declared["tools"]})) // 4)
    # "<user>\nx" is 8 characters, "<assistant>\nx" 13
    assert a["tools"] is None and b["tools"]["key"] and b["tools"]["tokens"] == (2 + 4) + (4 + 4) + declared_size


def lines(spark, *records):
    return spark.createDataFrame([("f", i + 1, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)], "file string, line_no bigint, raw string")


def test_tool_records_on_spark(spark):
    good = {"messages": said("user", "assistant!a", "tool:a", "assistant")}
    other = {"messages": said("user", "assistant!b", "tool:b", "assistant")}
    broken = {"messages": said("user", "assistant!a", "user", "assistant")}
    parsed = jsonl.parse(lines(spark, good, good, other, broken, SHARE))
    found = sorted((r.line_no, r.rule_id, r.kind) for r in api.findings_of(parsed, set(), None, 4096).collect())
    assert found == [(2, "duplicates", "duplicate"), (4, "roles", "alternation"), (4, "roles", "call never answered"), (5, "encoding", "garbled")]


@pytest.mark.parametrize(
    ("text", "redacted"),
    [
        ("write bob@mail.io, then jimbob@mail.io", "write [REDACTED_EMAIL], then [REDACTED_EMAIL]"),
        ("a@b.io or xa@b.io.example", "[REDACTED_EMAIL] or xa@b.io.example"),
        ("12+3456789012 = x, call +44 20 7946 0958", "12+3456789012 = x, call [REDACTED_PHONE]"),
        ("card 4539 1488 0343 6467 or 212-456-7890", "card [REDACTED_CARD] or [REDACTED_PHONE]"),
        ("ça é.bob@mail.io", "ça é[REDACTED_EMAIL]"),
        ("no@example.com 212-555-7890", "no@example.com 212-555-7890"),
        ("", ""),
    ],
)
def test_personal_data_is_replaced_at_its_place(text, redacted):
    assert pii.redact(text) == redacted


def test_fields():
    record = {"messages": said("user", "assistant"), "user": {"email": "a@corp.io", "phone": "212-456-7890", "sku": "212-456-7890", "ref": "4539 1488 0343 6467", "card": "4539 1488 0343 6467", "repo": "git@host.io:a/b.git"}, KEY: 1, "id": KEY}
    p = jsonl.parse_line(json.dumps(record))
    assert sorted((f["rule"], f["kind"]) for f in p["fields"]) == [("pii", "email address"), ("pii", "payment card number"), ("pii", "phone number"), ("secrets", "GitHub token"), ("secrets", "GitHub token")]
    clean = jsonl.redact_fields(record | {"[REDACTED_SECRET]": 2}, "openai-chat")
    assert clean["user"] == {"email": "[REDACTED_EMAIL]", "phone": "[REDACTED_PHONE]", "sku": "212-456-7890", "ref": "4539 1488 0343 6467", "card": "[REDACTED_CARD]", "repo": "git@host.io:a/b.git"}
    assert clean["id"] == "[REDACTED_SECRET]" and clean["[REDACTED_SECRET]"] == 1 and clean["[REDACTED_SECRET]_2"] == 2


def test_fix_round_trip(spark, tmp_path):
    records = [
        SHARE,
        {"messages": said("user", "assistant"), "id": KEY},
        {"instruction": "mail a@corp.io\n\nnow", "input": "cafÃ©\n\nend", "output": "o"},
        {"messages": [{"role": "user", "content": "x" * 40_000, "weight": 1}, {"role": "assistant", "content": "y"}]},
        {"messages": [{"role": "user", "content": "a" + "﻿" + "@corp.io"}, {"role": "assistant", "content": "y"}]},
    ]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in records))
    done = api.fix(spark, str(path))
    got = {r.line_no: json.loads(r.raw) for r in done.lines.collect()}
    share = json.loads(json.dumps(SHARE, ensure_ascii=False).replace("cafÃ©", "café"))
    assert got[1] == share and got[2] == records[1] | {"id": "[REDACTED_SECRET]"}
    assert got[3] == {"instruction": "mail [REDACTED_EMAIL]\n\nnow", "input": "café\n\nend", "output": "o"}
    assert got[4]["messages"][0]["weight"] == 1 and len(got[4]["messages"][0]["content"]) < 4096 * 4
    assert got[5]["messages"][0]["content"] == "[REDACTED_EMAIL]"
    fixed = {r.line_no: r.rules_fixed for r in done.outcomes.collect()}
    assert fixed == {1: ["encoding"], 2: ["secrets"], 3: ["encoding", "pii"], 4: ["context-window"], 5: ["encoding", "pii"]} and not done.fixer_errors


def test_a_repair_that_fails_is_reported(spark, tmp_path, monkeypatch):
    one = {"messages": [{"role": "user", "content": "cafÃ©"}, {"role": "assistant", "content": "y"}], "rejected": None, "prompt_len": None, "tools": None, "fields": None}
    monkeypatch.setitem(mending.FIXES, "encoding", lambda r, n: 1 / 0)
    assert mending.mended(one, frozenset(), 4096)["error"] == "encoding: ZeroDivisionError"
    monkeypatch.setitem(mending.FIXES, "encoding", lambda r, n: r)
    assert mending.mended(one, frozenset(), 4096)["error"] == "repairs did not come to an end"


PIECES = ["plain", " ", "", "cafÃ©", "﻿", "a@corp.io", "call 212-456-7890", "x@example.com", KEY, "sk-YOUR_API_KEY_HERE0", "y" * 600, None]


def test_rules_in_python_find_what_the_columns_find(spark):
    rnd = random.Random(5)
    message = lambda: (rnd.choice(["user", "assistant", "user", "assistant", "system", "bot", None]), rnd.choice(PIECES))
    rows = []
    for n in range(400):
        turns_ = [message() for _ in range(rnd.randrange(5))] if rnd.random() < 0.4 else [("user", rnd.choice(PIECES)), ("assistant", rnd.choice(PIECES))]
        pair = rnd.random() < 0.3
        rows.append(("f", n, rnd.choice([None, turns_]) if n % 20 == 0 else turns_, [("assistant", rnd.choice(PIECES))] if pair else None, min(1, len(turns_)) if pair else None))
    df = spark.createDataFrame(rows, f"file string, line_no bigint, messages {rec.MESSAGES}, rejected {rec.MESSAGES}, prompt_len int")
    by_columns = {}
    for r in rules.record_findings(df, max_seq_len=120).collect():
        by_columns.setdefault(r.line_no, set()).add(r.rule_id)
    for r in df.collect():
        d = r.asDict(recursive=True) | {"tools": None, "fields": None}
        hard = {n for n, rule in mending.UNFIXABLE.items() if rule(d)}
        assert hard | set(mending.pending(d, frozenset(), 120)) == by_columns.get(r.line_no, set()), d
    kept = repair.fixed(df, max_seq_len=120).where("messages is not null")
    assert rules.findings(kept, max_seq_len=120).count() == 0 and kept.count() > 20
    assert not any(secrets.find(m.content or "") for r in kept.collect() for m in r.messages)
