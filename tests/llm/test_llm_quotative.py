"""Questions without quotation marks that a particle and a verb of asking follow."""

from __future__ import annotations

import pytest

from loomsift.llm import sentences


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("もう行くの？と彼は聞いた。次の文です。", ["もう行くの？と彼は聞いた。", "次の文です。"]),
        ("誰だ！って叫んだ。", ["誰だ！って叫んだ。"]),
        ("本当ですか?と尋ねた。はい。", ["本当ですか?と尋ねた。", "はい。"]),
        ("もう行くの？とても遠い。", ["もう行くの？", "とても遠い。"]),
        ("行きますか？彼は聞いた。", ["行きますか？", "彼は聞いた。"]),
    ],
)
def test_a_question_and_who_asks_it_are_one_unit(text, expected):
    assert [text[s:e].strip() for s, e in sentences.units(text)] == expected
