"""Gaps in Chinese, Japanese and Thai text, weighed by the words of whole runs."""

from __future__ import annotations

from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsift.llm import sentences


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        # a reporting clause of any length, and one that goes on after its verb
        ("“你好吗？”她看着窗外那条很长很长而且没有人的街道，很久以后才轻轻地问道。他走了。", ["“你好吗？”她看着窗外那条很长很长而且没有人的街道，很久以后才轻轻地问道。", "他走了。"]),
        ("“你好吗？”他问，然后走了。", ["“你好吗？”他问，然后走了。"]),
        ("「行く？」彼は聞いた。次。", ["「行く？」彼は聞いた。", "次。"]),
        ("もう行くの？と、長い廊下の向こうに立っていた担当者が静かな声でゆっくりと尋ねた。次。", ["もう行くの？と、長い廊下の向こうに立っていた担当者が静かな声でゆっくりと尋ねた。", "次。"]),
        # words that only hold a particle or a reporting verb
        ("“真的吗？”他知道。", ["“真的吗？”", "他知道。"]),
        ("「行く？」とても遠い。", ["「行く？」", "とても遠い。"]),
        ("“走吧。”那么我们走吧。", ["“走吧。”", "那么我们走吧。"]),
        # a final particle before an ellipsis, an unfinished clause, a word that goes on
        ("他走了……那天很冷。", ["他走了……", "那天很冷。"]),
        ("样本……那天很冷。", ["样本……那天很冷。"]),
        ("私は……行かない。", ["私は……行かない。"]),
        ("样本...然后停止了。", ["样本...然后停止了。"]),
        # a dot before a particle
        ("担当者はetc.の副本を見た。次。", ["担当者はetc.の副本を見た。", "次。"]),
        ("“มาไหม?” เขาถาม แล้วเขาก็ไป", ["“มาไหม?” เขาถาม", "แล้วเขาก็ไป"]),
        ("“มาไหม?” ฝนตก", ["“มาไหม?”", "ฝนตก"]),
        ("เขาไป… แต่กลับมา", ["เขาไป… แต่กลับมา"]),
    ],
)
def test_words_beside_a_gap_decide_it(text, expected):
    assert [text[s:e] for s, e in sentences.units(text)] == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="とても問道知说了……的那么", max_size=12))
def test_the_lattice_path_is_the_cheapest(text):
    words = {w for kinds in sentences.DICTIONARY.values() for w in kinds.split()}

    @cache
    def least(at):
        if at == len(text):
            return 0.0
        return min([1.5 + least(at + 1), *(1 + least(k) for k in range(at + 1, len(text) + 1) if text[at:k] in words)])

    path = sentences.lattice(text)
    assert [a for a, _, _ in path] == [0, *(b for _, b, _ in path)][: len(path)] and (not path or path[-1][1] == len(text))
    assert sum(1 if kinds else 1.5 for _, _, kinds in path) == least(0)


def test_a_long_run_is_segmented_whole():
    run = "样本的词表" * 20_000
    path = sentences.lattice(run + "了")
    assert path[-1][2] >= {"final"} and len(path) == 100_001
    text = run + "了……那天很冷。"
    assert [text[s:e] for s, e in sentences.units(text)] == [run + "了……", "那天很冷。"]
