"""JSON lines: shapes, numbering, round trips, and the file commands."""

from __future__ import annotations

import json

import pytest

from loomsift.plans import api
from loomsift.sources import jsonl
from loomsift.streaming import checks

CHAT = {"messages": [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "hi"}], "id": 7}
SHAREGPT = {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}
PAIR = {"prompt": "p", "completion": "c"}
ALPACA = {"instruction": "i", "input": "x", "output": "o", "history": [["u", "v"]]}
PREFERENCE = {"prompt": "p", "chosen": "c", "rejected": "r"}
IMPLICIT = {"chosen": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "c"}], "rejected": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "r"}]}


@pytest.mark.parametrize(
    ("record", "shape", "turns", "prompt_len"),
    [
        (CHAT, "openai-chat", [("user", "hello"), ("assistant", "hi")], None),
        (SHAREGPT, "sharegpt", [("system", "s"), ("user", "a"), ("assistant", "b")], None),
        (PAIR, "prompt-completion", [("user", "p"), ("assistant", "c")], None),
        (ALPACA, "alpaca", [("user", "u"), ("assistant", "v"), ("user", "i\n\nx"), ("assistant", "o")], None),
        (PREFERENCE, "preference", [("user", "p"), ("assistant", "c")], 1),
        (IMPLICIT, "preference", [("user", "p"), ("assistant", "c")], 1),
        ({**IMPLICIT, "prompt": "p"}, "preference", [("user", "p"), ("assistant", "c")], 1),
        ({**IMPLICIT, "messages": []}, "preference", [("user", "p"), ("assistant", "c")], 1),
        ({**IMPLICIT, "conversation": [{"input": 1}]}, "preference", [("user", "p"), ("assistant", "c")], 1),
    ],
)
def test_shapes(record, shape, turns, prompt_len):
    parsed = jsonl.parse_line(json.dumps(record))
    assert parsed["source_format"] == shape and parsed["field_errors"] == []
    assert [(m["role"], m["content"]) for m in parsed["messages"]] == turns and parsed["prompt_len"] == prompt_len


@pytest.mark.parametrize("record", [CHAT, SHAREGPT, PAIR, ALPACA, PREFERENCE, IMPLICIT])
def test_round_trip(record):
    raw = json.dumps(record)
    p = jsonl.parse_line(raw)
    assert json.loads(jsonl.restored(raw, p["source_format"], p["messages"], p["rejected"], p["prompt_len"])) == record


def test_faults():
    for raw, part in (("{", "column"), ("[" * 100_000, "nested"), ("1" * 5000, "refuses")):
        assert part in jsonl.parse_line(raw)["parse_error"]
    assert jsonl.parse_line("3")["field_errors"] == ["the line is no object"]
    assert jsonl.parse_line('{"instruction": 1}')["field_errors"] == ["instruction is missing or no text", "output is missing or no text"]
    assert jsonl.parse_line('{"messages": 1}')["field_errors"] == ["messages are no list"]
    with pytest.raises(KeyError):
        jsonl.normalize({}, "xml")
    call = {"id": "1", "type": "function", "function": {"name": "f", "arguments": "{}"}}
    tools = [{"type": "function", "function": {"name": "f", "parameters": {}}}]
    turns = lambda *calls: {"tools": tools, "messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": None, "tool_calls": list(calls)}]}
    errors = lambda r: jsonl.parse_line(json.dumps(r))["tool_errors"]
    assert errors(turns(call)) == []
    assert errors(turns(call, call)) == ["the id of a call repeats"]
    assert errors(turns({"function": {"name": "g", "arguments": "x"}})) == ["a call is not of type function", "a call of an undeclared tool", "arguments of a call are no object"]
    assert errors(turns()) == ["an empty list of calls"]


DIRTY = [CHAT, CHAT, {"messages": [{"role": "user", "content": "q"}]}, {"messages": [{"role": "user", "content": "cafÃ©"}, {"role": "assistant", "content": "b"}]}]


@pytest.fixture
def dirty(tmp_path):
    path = tmp_path / "dirty.jsonl"
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in DIRTY[:3]) + "\n" + json.dumps(DIRTY[3], ensure_ascii=False) + "\nnot json\n")
    return path


def test_commands(spark, dirty, tmp_path):
    result = api.check(spark, str(dirty), output=str(tmp_path / "clean"))
    got = sorted((r.line_no, r.rule_id) for r in result.findings.collect())
    assert got == [(2, "duplicates"), (3, "roles"), (5, "encoding"), (6, "schema")]
    assert (result.total, result.valid, result.exit_code) == (5, 2, 2)
    assert [x["line_no"] for x in result.to_dict(2)["issues"]] == [2, 3] and result.to_dict(2)["issues_truncated"]
    fixed = api.fix(spark, str(dirty), output=str(tmp_path / "fixed"))
    assert fixed.counts == {"unchanged": 1, "dropped": 2, "fixed": 1, "unparseable": 1} and fixed.exit_code == 1
    lines = [json.loads(r.raw) for r in fixed.lines.orderBy("line_no").collect()]
    assert lines == [CHAT, {"messages": [{"role": "user", "content": "café"}, {"role": "assistant", "content": "b"}]}]
    summary = api.report(spark, str(dirty))
    assert summary["rates"]["clean_fraction"] == 0.4 and summary["duplicates"][0]["redundant"] == 1
    assert "| duplicates | 1 | 0 |" in api.markdown(summary)
    with pytest.raises(ValueError):
        api.check(spark, str(dirty), output=str(dirty))


def test_line_numbers_over_files_and_blocks(spark, tmp_path):
    for name, n in (("a", 1000), ("b", 37)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = jsonl.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 1037 and all(r.line_no == int(r.raw) for r in rows)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("f", i + 1, json.dumps(r)) for i, r in enumerate(DIRTY)], "file string, line_no bigint, raw string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("file string, line_no bigint, raw string").parquet(str(tmp_path / "in"))
    found = checks.stream_findings(checks.parsed_stream(lines), ["roles", "encoding"])
    query = found.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.line_no, r.rule_id) for r in spark.sql("select * from found").collect()) == [(3, "roles"), (4, "encoding")]
