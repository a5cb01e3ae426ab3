"""Answers that repeat their question any number of times."""

from __future__ import annotations

import pytest

from loomsift.llm import defects

ASKED = "Name the harbour that the northern ferry leaves from every morning."


@pytest.mark.parametrize("times", [1, 3, 4, 5, 9, 40])
def test_a_question_repeated_is_an_echo(times):
    assert defects.is_echo(" ".join([ASKED] * times), ASKED, "")
    assert defects.is_echo(" ".join(["Why now?"] * times), "Why now?", "")
    assert defects.is_echo(" ".join([ASKED + " Ports: Oban."] * times), ASKED, "Ports: Oban.")
    assert not defects.is_echo(" ".join([ASKED] * times) + " It is Oban, where two lines and the night boat meet the train from Glasgow.", ASKED, "")


def test_short_answers_are_compressed_too(monkeypatch):
    seen = []
    measure = defects._compressed
    monkeypatch.setattr(defects, "_compressed", lambda a, q: seen.append(a) or measure(a, q))
    assert defects.is_echo("Why now?", "Why now?", "") and seen
    assert not defects.is_echo("Rain fell on the long road", "Why now?", "")


def test_words_compared_in_order():
    assert defects._near(list("abcd"), list("abxcd"), 1) and not defects._near(list("abcd"), list("dcba"), 3)
    assert defects._near(list("abcd"), list("dcba"), 6)
