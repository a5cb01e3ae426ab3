"""Text operators on fixed cases, without Spark."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomsift.llm import canon, defects, mojibake, pii, sentences

FINDER = pii.Finder(frozenset(["Amber", "Tavia", "Mark", "Ledger"]), frozenset(["Dornavik", "Rask-Ellen", "Stone"]))


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("write to a.b@corp.qx please", ["email"]),
        ("write to a_b (at) mail (dot) corp (dot) qx", ["email"]),
        ("a.b @ corp.qx", ["email"]),
        ("tavia.stone@corp.qx", ["email"]),
        ("a@example.com, b@x.invalid, c@y.test", []),
        ("clone git@host:group/name first, ping @some-bot", []),
        ("call me on +834 (0)30 6616585", ["phone"]),
        ("tel. 09250 / 46 67 91 or 491.363.8437", ["phone"]),
        ("use (236) 555-2494 in the sample rows", []),
        ("Ticket 768-1562-85 is open. Totals: 925 991 1728 tokens. Build 3.5.47.615. At 2031-01-11 16:31:42.", []),
        ("My national ID is 931411-2742.", ["id_number"]),
        ("The SSN on file, 959-28-9540, is wrong", ["id_number"]),
        ("护照号码KW8671976。", ["id_number"]),
        ("Carte d’identité n° QW5199577", ["id_number"]),
        ("The order no. QK9445281 was closed", []),
        ("we live at 183 Brindle Street, Osthagen", ["address"]),
        ("Lieferung bitte an Tolvertonstraße 4b, 51220 Quenby Falls", ["address"]),
        ("J’habite 96 bis, allée des Brindle", ["address"]),
        ("Vivo en C/ Arrow Mill 103, 2.º B", ["address"]),
        ("ул. Тессалийская, д. 80, кв. 81", ["address"]),
        ("寄到松泊路85号185室", ["address"]),
        ("PO Box 37801, Quenby Falls", ["address"]),
        ("Read chapter 28, Road Map and Lane Detection.", []),
        ("My name is Hestrine Ettrane.", ["name"]),
        ("Assigned to Rask-Ellen, Tavia.", ["name"]),
        ("i am amber stone and i own the account", ["name"]),
        ("Ask for Dr. Marwick-Oss at the desk", ["name"]),
        ("H. Dornavik reviewed the batch", ["name"]),
        ("All done.\nThanks,\nTavia", ["name"]),
        ("我叫司棠野。", ["name"]),
        ("Меня зовут Орест Бреловский.", ["name"]),
        ("The team behind Amber Ledger wrote it. Mark every page of the rose report in May.", []),
        ("the amber ledger of stone", []),
        ("", []),
    ],
)
def test_pii(text, kinds):
    assert FINDER.kinds(text) == kinds


def test_redaction_keeps_other_words():
    text = "Hi, I am Tavia Stone, mail t@corp.qx or call 491.363.8437."
    assert FINDER.redacted(text) == "Hi, I am [NAME], mail [EMAIL] or call [PHONE]."


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_redaction_never_fails_and_items_are_apart(text):
    items = FINDER.items(text)
    assert all(a.end <= b.start for a, b in zip(items, items[1:], strict=False))
    assert all(0 <= x.start < x.end <= len(text) for x in items)


PLAIN = ["Fußnote „größer“ — ça va, señor…", "Отчёт опережает словарь журнала проверки", "评估样本延迟了审核队列，这正常吗？", "It’s the café’s naïve rule… • 5 × 3"]


@pytest.mark.parametrize("text", PLAIN)
@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1250"])
def test_wrong_decoding_is_found_and_undone(text, encoding):
    damaged = text.encode().decode(encoding, "replace")
    if "�" in damaged:
        damaged = "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode())
    restored, found, _ = mojibake.repair(damaged)
    assert found
    if encoding in ("latin-1", "cp437", "mac_roman"):
        assert restored == text


def test_double_damage_and_single_byte_swaps():
    text = "Prüfsumme genügt für größere Fälle"
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert mojibake.repair(twice) == (text, True, False)
    text = "Журнал проверки перекрывает словарь почти в строках"
    assert mojibake.repair(text.encode("cp1251").decode("latin-1"))[:2] == (text, True)
    assert mojibake.repair(text.encode("koi8_r").decode("cp1251"))[:2] == (text, True)
    assert mojibake.repair("检查报告截断了检查报告".encode("gb2312").decode("latin-1"))[:2] == ("检查报告截断了检查报告", True)
    assert mojibake.repair("F�r das")[1:] == (True, True)
    assert mojibake.repair("We can\x92t")[:2] == ("We can’t", True)


@pytest.mark.parametrize("text", [*PLAIN, "Region: MANHÃ NORTE. See “Âge moyen”. Label: SÃO DORVAL.", "Cột “ĐÃ XÁC NHẬN” ÂM THANH", "Ð-series, Å units, ±78 µm", "été » et « naïve", "﻿a​b\xa0c", "plain", ""])
def test_correct_text_is_no_case(text):
    assert mojibake.repair(text) == (text, False, False)


def cut(text):
    return [text[s:e] for s, e in sentences.units(text)]


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("Dr. Velanor and T. Stone met at 6 p.m. today. It cost $1,216.50 per run.", ["Dr. Velanor and T. Stone met at 6 p.m. today.", "It cost $1,216.50 per run."]),
        ("It holds shards, logs, etc.. The ratio fell to 0.8 in v5.5.2.\n\nNext", ["It holds shards, logs, etc..", "The ratio fell to 0.8 in v5.5.2.", "Next"]),
        ("The note said “One. Two.” Then it ended. “Why?” asked the reviewer.", ["The note said “One. Two.”", "Then it ended.", "“Why?” asked the reviewer."]),
        ("First. (A whole one.) The box (see No. 10 in the list!) shadows it.", ["First.", "(A whole one.)", "The box (see No. 10 in the list!) shadows it."]),
        ("## Notes v. 2\nSome text here. More.\n- one item. with two\n- b", ["## Notes v. 2", "Some text here.", "More.", "- one item. with two", "- b"]),
        ("A line that is\nwrapped. Ends...", ["A line that is\nwrapped.", "Ends..."]),
        ("it stops before step 7... probably.The pool is train.a.jsonl now.", ["it stops before step 7... probably.", "The pool is train.a.jsonl now."]),
        ("in our setup it ends. on the test bench it starts, i.e. now.", ["in our setup it ends.", "on the test bench it starts, i.e. now."]),
        ("Z. B. die Liste. Der 14. Lauf, d. h. der letzte, endet am 18. Mai. Seit Lauf 2653. Die Zahl.", ["Z. B. die Liste.", "Der 14. Lauf, d. h. der letzte, endet am 18. Mai.", "Seit Lauf 2653.", "Die Zahl."]),
        ("„Ist das so?“, fragte die Prüferin. Ja.", ["„Ist das so?“, fragte die Prüferin.", "Ja."]),
        ("« Vraiment ? » demande la relectrice. Non !", ["« Vraiment ? » demande la relectrice.", "Non !"]),
        ("En EE. UU. la muestra, p. ej. en la pág. 2. ¿Sí?", ["En EE. UU. la muestra, p. ej. en la pág. 2.", "¿Sí?"]),
        ("См. рис. 16 и т. д. до конца. «Так?» — спросил он.", ["См. рис. 16 и т. д. до конца.", "«Так?» — спросил он."]),
        ("他写道：“一。二。”评估0.899。（三。）“四？”审核员问道。缓存……然后停止了。", ["他写道：“一。二。”", "评估0.899。", "（三。）", "“四？”审核员问道。", "缓存……然后停止了。"]),
        ("「上書きした？」と担当者が尋ねた。次。", ["「上書きした？」と担当者が尋ねた。", "次。"]),
        ("ไฟล์ a.json มี 60 ชุด รุ่น 3.2 ซ่อน", ["ไฟล์ a.json มี 60 ชุด", "รุ่น 3.2 ซ่อน"]),
        ("डॉ. लोरिन का मान 1.31 है। दूसरा॥", ["डॉ. लोरिन का मान 1.31 है।", "दूसरा॥"]),
        ("يرى د. أورست ذلك؟ كتب: «فارغة.» نعم.", ["يرى د. أورست ذلك؟", "كتب: «فارغة.»", "نعم."]),
        (" \n ", []),
    ],
)
def test_sentences(text, units):
    assert cut(text) == units


def test_no_text_and_long_text():
    assert sentences.units(None) == []
    assert len(sentences.units("One two three. " * 50_000)) == 50_000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aA .!?\n\"“”()（）「」。，1-…'’«»", max_size=120))
def test_units_cover_every_character(text):
    units = sentences.units(text)
    assert all(a < b for a, b in units)
    assert all(x[1] <= y[0] for x, y in zip(units, units[1:], strict=False))
    inside = set().union(*(range(a, b) for a, b in units)) if units else set()
    assert all(text[i].isspace() for i in range(len(text)) if i not in inside)


ENDINGS = defects.Endings(["The balanced scheduler follows the narrow registry after the upgrade of the sampled corpus."] * 3)
QUESTION = "How can I tell whether the merged connector delays the older tokenizer during the second pass?"


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        (None, "empty"), (" \t​", "empty"), ("n/a", "empty"), ("<empty>", "empty"), ("—", "empty"), ("[no answer]", "empty"), ("no", None), ("45", None), ("a.jsonl", None), ("0.57", None),
        ("I'm sorry, but I can't help with that. Try a different topic.", "refusal"), ("很抱歉，我无法回答这个问题。", "refusal"), ("Leider diese Anfrage muss ich ablehnen.", "refusal"),
        ("I can't see your screen, but the fix is short. Restart the connector and the tokenizer is on time again.", None), ("Apologies for the wait. The connector was merged twice.", None),
        (QUESTION, "echo"), (QUESTION.upper() + " **", "echo"), ("Question: " + QUESTION, "echo"), (QUESTION.replace("merged ", ""), "echo"), (QUESTION + "\n" + QUESTION, "echo"),
        ("Die Gewichtung löscht das Gespräch und das alte Archiv ist nicht mit der Kopie von gestern gleich.", "wrong_language"), ("Журнал проверки задерживает разбор диалога на медленных машинах.", "wrong_language"),
        ("The connector delays it. The other one of", "truncated"), ("The connector delays it,", "truncated"), ("Do this:\n```python\nx = 1", "truncated"), ("Do this:\n```python\nx = 1\n```", None), ("Two steps.\n- the first\n- the second one", None), ("Two steps.\n- the first\n- the second and the", "truncated"), ("Two steps.\n1. the first\n2.", "truncated"),
        ("The connector delays it. (≈ 445 € · naïve estimate)", None),
    ],
)
def test_defects(answer, expected):
    assert defects.defect(answer, QUESTION, None, ENDINGS) == expected


def test_defects_without_a_question_and_asked_languages():
    assert defects.defect("Das ist eine Antwort und nicht mehr als das.", None, None, ENDINGS) is None
    assert defects.defect("Das ist eine Antwort und nicht mehr als das.", QUESTION + " Answer in German.", None, ENDINGS) is None
    assert defects.conversation_answer('[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]') == ("q", "a", True)
    assert defects.conversation_answer("plain") == (None, "plain", False)
    assert defects.conversation_answer(None) == (None, None, False)


def test_json_keys():
    a = canon.json_key('{"a": 1.0, "m": [{"x": "Hello, World", "y": null}], "b": true}')
    assert a == canon.json_key('{"b":true,"m":[{"y":null,"x":"hello world!"}],"a":1e0}')
    assert a != canon.json_key('{"b":1,"m":[{"y":null,"x":"hello world!"}],"a":1}')
    assert canon.json_key('{"a": [1, 2]}') != canon.json_key('{"a": [2, 1]}')
    assert canon.json_key('{"a": null}') != canon.json_key('{"a": ""}')
    assert [canon.json_key(x) for x in (None, "", "{", "3", "[1]", "[" * 100_000)] == [None] * 6
