"""Operators on small tables, against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsift.llm import canon, defects, mixing, mojibake, overlap, packing, pii, queries, sentences, tokens

CHAT = "line_no bigint, messages array<struct<role:string,content:string>>, key string, table_name string, h string"


def test_runs_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(3)
    texts = [rnd.choice(["Hot key!", "hot KEY", " hot-key "]) if rnd.random() < 0.4 else f"text {rnd.randrange(60)}{rnd.choice('.!?')}" for _ in range(900)]
    rows = [(i, [("user " if i % 2 else "USER", t)], "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [(1000, None, "", "", ""), (1001, None, "", "", ""), (1002, [("user", None)], "", "", ""), (1003, [("user", None)], "", "", ""), (1004, [("user", "")], "", "", ""), (1005, [], "", "", "")]
    df = spark.createDataFrame(rows, CHAT)
    assigned = canon.runs(canon.keyed_chat(df, "t", "messages", "role", "content"), 5)
    first, expected = {}, set()
    for i, turns, *_ in rows:
        if turns:
            key = str([("".join(r.split()).lower(), t if t is None else "".join(c for c in t.casefold() if c.isalnum())) for r, t in turns])
            if key in first:
                expected.add(("t", first[key], i))
            first.setdefault(key, i)
    assert {tuple(r) for r in canon.copies(assigned).collect()} == expected
    groups = {r.line_no: r.copies for r in canon.collapsed(assigned).collect()}
    assert sum(groups.values()) == 903 and set(groups) == set(first.values())


def test_runs_of_nothing(spark):
    df = spark.createDataFrame([], CHAT)
    assert canon.copies(canon.runs(canon.keyed_chat(df, "t", "messages", "role", "content"))).count() == 0
    lines = spark.createDataFrame([(1, None), (2, "{"), (3, '{"a":1}'), (4, '{ "a" : 1.0 }')], "line_no bigint, raw string")
    assert [tuple(r) for r in canon.copies(canon.runs(canon.keyed_lines(lines, "raw"))).collect()] == [("raw", 3, 4)]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_edit_distance():
    rnd = random.Random(1)
    for _ in range(400):
        a = [rnd.randrange(5) for _ in range(rnd.randrange(14))]
        b = [rnd.randrange(5) for _ in range(rnd.randrange(14))]
        most = rnd.randrange(8)
        assert overlap.edit_distance(a, b, most) == min(_distance(a, b), most + 1)


def _near_rows(rnd, n):
    base = [[rnd.choice("abcdefghij") * rnd.choice((1, 2, 3)) for _ in range(rnd.randrange(1, 24))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 6)):
            at = rnd.randrange(len(words) + 1)
            kind = rnd.randrange(3)
            if kind == 0:
                words.insert(at, rnd.choice("xyz"))
            elif words and kind == 1:
                words.pop(min(at, len(words) - 1))
            elif words:
                words[min(at, len(words) - 1)] = rnd.choice("xyz")
        rows.append((i, rnd.choice(["train", "train", "dev", "TEST ", None]), "s", rnd.choice((" ", ", ")).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 10**6), (2, 150)])
def test_overlap_against_brute_force(spark, seed, block):
    rows = [*_near_rows(random.Random(seed), 260), (900, "train", None, None), (901, "dev", "s", ""), (902, "dev", "s", "...")]
    df = spark.createDataFrame(rows, "line_no bigint, split string, source string, text string").withColumn("words", F.lit("clash"))
    sided = overlap.sided(df, "t", F.col("text"))
    got = {(r.train_line, r.eval_line): r.distance for r in overlap.row_pairs(sided, overlap.text_pairs(sided, block)).collect()}
    split = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t).split()]
    said = [(i, s.strip().lower(), split(t)) for i, s, _, t in rows if s and t and split(t)]
    expected = {}
    for i, s, a in said:
        for j, r, b in said:
            if s == "train" and r in ("dev", "test"):
                d = _distance(a, b)
                if d <= max(len(a), len(b)) // 5:
                    expected[i, j] = d
    assert got == expected and expected


def test_overlap_of_nothing(spark):
    df = spark.createDataFrame([], "line_no bigint, split string, source string, text string")
    sided = overlap.sided(df, "t", F.col("text"))
    assert overlap.row_pairs(sided, overlap.text_pairs(sided)).count() == 0


@pytest.mark.parametrize("capacity", [7, 100, 1000])
def test_packing_is_whole_and_near_the_bound(capacity):
    rnd = np.random.default_rng(capacity)
    items = rnd.integers(1, capacity + 1, 800)
    where = packing.pack(items, capacity)
    filled = np.bincount(where, weights=items)
    assert (where >= 0).all() and filled.max() <= capacity
    big = (items * 2 > capacity).sum()
    assert len(filled) <= max(-(-items.sum() // capacity), big) * 1.03 + 1
    assert packing.pack(np.zeros(0, np.int64), capacity).size == 0
    assert len(set(packing.pack(np.full(10, capacity), capacity))) == 10


def test_packed_table(spark):
    rows = [(1, 5), (2, 25), (3, 10), (4, 0), (5, None), (6, 7), (6, 7), (None, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens bigint").withColumn("pack_id", F.lit("clash"))
    out = packing.packed(df, {1: 10, 2: 100}, 3).collect()
    for pack, capacity in ((1, 10), (2, 100)):
        own = [r for r in out if r.pack_id == pack]
        total = defaultdict(int)
        for r in own:
            total[r.container] += r.tokens
        assert max(total.values()) <= capacity and sum(total.values()) == 57
        assert sorted(r.piece for r in own if r.doc_id == 2) == ([0, 1, 2] if pack == 1 else [0])
    assert packing.packed(df.where("false"), {1: 10}).count() == 0
    with pytest.raises(ValueError):
        packing.packed(df, {1: 0})


def _mix_rows(rnd, n):
    return [(i, rnd.choice("aaabc"), rnd.randrange(n), 0, rnd.randrange(1, 40)) for i in range(n)]


def test_mixture(spark):
    rows = [(i, s, h, 0, 1 + h % 37) for i, s, h, _, _ in _mix_rows(random.Random(5), 600)]
    rows += [(9000, None, 1, 1, 5), (9001, "unlisted", 2, 1, 5), (9002, "a", 3, 1, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, h1 bigint, h2 bigint, tokens bigint").withColumn("pattern", F.lit("clash"))
    targets = {"a": mixing.Target(0.5, 1), "b": mixing.Target(0.3, 3), "c": mixing.Target(0.1, 4), "gone": mixing.Target(0.1, 2)}
    chosen, shares = mixing.mixture(df, targets)
    out = chosen.collect()
    text, limit = {r[0]: (r[2], r[3]) for r in rows}, {"a": 1, "b": 3, "c": 4}
    sources = defaultdict(set)
    for i, s, h1, h2, _ in rows:
        if s in limit:
            sources[h1, h2].add(s)
    used = Counter()
    for r in out:
        assert r.source in sources[text[r.doc_id]]
        used[text[r.doc_id]] += r.repeats
    assert all(n <= min(limit[s] for s in sources[t]) for t, n in used.items())
    got = {r.source: r for r in shares.collect()}
    assert got["gone"].tokens == 0
    for s in limit:
        assert abs(got[s].actual_share - got[s].quota_share) < 0.01
    again = mixing.mixture(df, targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    small = {r.source: r.tokens for r in mixing.mixture(df, targets, total_tokens=1000)[1].collect()}
    assert abs(sum(small.values()) - 1000) < 60
    empty, none = mixing.mixture(df.where("false"), targets)
    assert empty.count() == 0 and {r.tokens for r in none.collect()} == {0}


def test_flow_prefers_fewer_repeats():
    targets = {"a": mixing.Target(0.5, 3), "b": mixing.Target(0.5, 3)}
    flows, routed = mixing.route({("a",): 100.0, ("b",): 100.0, ("a", "b"): 100.0}, targets, 300.0)
    assert routed == pytest.approx(300) and sum(flows.values()) == pytest.approx(300)
    assert flows[("a",), "a"] == pytest.approx(100) and flows[("b",), "b"] == pytest.approx(100)


def test_tables_of_texts_with_nulls_and_clashing_columns(spark):
    names = spark.createDataFrame([("Tavia", "given", 1), (None, "given", 2), ("Stone", "family", 3)], "person_name string, kind string, name_id bigint")
    df = spark.createDataFrame([(1, None), (2, [("a", None), ("b", "I am Tavia Stone, t@corp.qx")]), (3, [("a", "Ã¼ber")]), (4, [])], "line_no bigint, messages array<struct<role:string,content:string>>").withColumn("kind", F.lit(1)).withColumn("text", F.lit(2))
    texts = queries.turn_texts(df, "t", "messages", "content")
    assert sorted((r.line_no, r.turn, r.kind) for r in pii.kinds_found(texts, names).collect()) == [(2, 1, "email"), (2, 1, "name")]
    assert [r.redacted for r in pii.redacted(texts, names).collect()] == ["I am [NAME], [EMAIL]"]
    assert [(r.line_no, r.turn, r.restored, r.incomplete) for r in mojibake.damaged_texts(texts).collect()] == [(3, 0, "über", False)]
    docs = spark.createDataFrame([(1, None), (2, " "), (3, "One. Two."), (3, "One. Two.")], "doc_id bigint, text string").withColumn("start_pos", F.lit("clash"))
    assert sorted(map(tuple, sentences.sentence_units(docs).collect())) == [(3, 0, 4), (3, 0, 4), (3, 5, 9), (3, 5, 9)]
    assert sorted(map(tuple, tokens.sized(docs.select("doc_id", "text")).collect()))[0] == (2, 1)
    for none in (pii.kinds_found(texts.where("false"), names), mojibake.damaged_texts(texts.where("false")), sentences.sentence_units(docs.where("false"))):
        assert none.count() == 0


def test_defects_table(spark):
    schema = "table_name string, line_no bigint, field_name string, question string, extra string, answer string"
    rows = [
        ("p", 1, "chosen", None, None, '[{"role":"user","content":"what is it?"},{"role":"assistant","content":"n/a"}]'), ("p", 1, "rejected", None, None, None),
        ("a", 2, "output", "", None, "fine."), ("a", 3, "output", None, None, "This breaks off in the"), ("a", 4, "output", "q", "i", "45"),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("defect", F.lit("clash"))
    got = {(r.line_no, r.field_name): r.defect for r in defects.defects(df).collect()}
    assert got == {(1, "chosen"): "empty", (1, "rejected"): "empty", (3, "output"): "truncated"}
    assert defects.defects(df.where("false")).count() == 0


def test_every_query_is_made(spark):
    assert all(name in queries.QUERIES for name in ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_packing", "p7_mix", "p8_found"))
