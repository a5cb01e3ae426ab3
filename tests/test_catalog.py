"""Registered queries over small tables."""

from __future__ import annotations

import hashlib

import pytest

from loomsift.plans import catalog

KEY = "AKIA" + "Q7RZ2MNB4KXC9WTD"
CHAT = "line_no bigint, messages array<struct<role:string,content:string>>, split string"
TURNS = "line_no bigint, conversations array<struct<from:string,value:string>>"
INSTRUCTIONS = "line_no bigint, instruction string, input string, output string, system string, history array<array<string>>, split string"
PREFERENCES = "line_no bigint, prompt string, chosen string, rejected string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Line 1 holds a credential, line 2 an address, line 3 nothing; line 600 is past any range of lines."""
    at = str(tmp_path_factory.mktemp("tables"))
    said = lambda x: [("user", x), ("assistant", "yes")]
    rows = [(1, said(f"the key is {KEY}"), "test"), (2, said("write to jo@corp.io"), "test"), (3, said("plain"), "train"), (600, said("late"), "train")]
    spark.createDataFrame(rows, CHAT).write.parquet(f"{at}/clean.parquet")
    spark.createDataFrame([(1, [("human", "hello"), ("gpt", "hi")])], TURNS).write.parquet(f"{at}/sharegpt_clean.parquet")
    spark.createDataFrame([(1, "add", "", "done", "", [], "train")], INSTRUCTIONS).write.parquet(f"{at}/alpaca_clean.parquet")
    spark.createDataFrame([(1, "pick", "a", "b")], PREFERENCES).write.parquet(f"{at}/preference_clean.parquet")
    return at


def rows(spark, folder, name):
    return sorted(map(tuple, catalog.QUERIES[name](spark, folder).collect()))


def test_reports_run_every_rule(spark, folder):
    whole = lambda name: rows(spark, folder, name)
    others = [("alpaca_clean", 1), ("preference_clean", 1), ("sharegpt_clean", 1)]
    assert whole("issues_by_rule") == [("pii", 0, 1, 0), ("secrets", 1, 0, 0)]
    assert whole("affected_lines") == [("clean", 1, 1)]
    assert whole("issues_in_order") == [("clean", 1, "error", "secrets", 0, "AWS access key"), ("clean", 2, "warning", "pii", 0, "email address")]
    assert whole("clean_lines") == sorted([("clean", 2), ("clean", 3), ("clean", 600), *others])
    assert dict(whole("exit_codes")) == {"clean": 2, "alpaca_clean": 0, "preference_clean": 0, "sharegpt_clean": 0}
    assert whole("rule_masks") == [("clean", 1, 1 << 8), ("clean", 2, 1 << 9)]
    assert ("clean", 4, 0.75, 0.25, 0.25, 0.0) in whole("report_rates")
    assert whole("row_query_clean") == sorted([("clean", 3), ("clean", 600), *others])


def test_regressions_run_every_rule(spark, folder):
    assert rows(spark, folder, "regressions") == [("clean", "clean_fraction", 1.0, 0.5), ("clean", "error_rate", 0.0, 0.5), ("clean", "warning_rate", 0.0, 0.5)]


def test_texts_that_open_alike_are_different_prompts(spark, tmp_path):
    texts = ["x" * 40 + f" ends in {i}" for i in range(12)]
    spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)] + [(12, "de", texts[0]), (13, "en", None)], "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    parts = {r.doc_id: r.part for r in catalog.QUERIES["split_by_prompt_hash"](spark, str(tmp_path)).collect()}
    order = sorted(range(12), key=lambda i: hashlib.sha256(texts[i].encode()).hexdigest())
    assert [parts.get(i) for i in order] == ["test"] * 5 + ["dev"] * 5 + ["train" if i else None for i in order[10:]]
    assert parts[12] == "test" and 13 not in parts


def test_related_leakage_looks_at_every_language(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "same text", "a", "EN"), (2, "Same text", "b", None), (3, "other", "c", "en"), (4, "fourth", "c", "fr"), (5, words, "d", "en"), (6, words + " end", "e", "DE"), (7, "alone", "f", "en")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r[:3] for r in rows(spark, str(tmp_path), "related_leakage")] == [(1, 2, "exact"), (3, 4, "related"), (5, 6, "near")]
