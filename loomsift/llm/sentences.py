"""Sentence units of documents in any of ten languages (problem 8).

A document is cut into blocks at blank lines, a block into headings, list items and
running text. Running text in spaced scripts becomes a lattice of terminator gaps,
each classified by the token before it, what closes after it and what opens next.
Runs of Chinese, Japanese and Thai letters are segmented whole by a lattice over a
dictionary of particles, reporting verbs and opening words; every gap there is weighed
by its mark, the word before it, the word behind it and the clause that follows
(``WEIGHTS``). A blank between two Thai letters always ends a unit. Quotations and
brackets are matched first: gaps inside them are no gaps.

Null and blank texts have no units. Texts of any length are scanned whole, in time
linear in their length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

# Abbreviations, lower case, without their last dot.
#: Never end a unit: a name, number or further word follows.
OPEN_ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof st mt gen col capt lt sgt rev hon fig figs sec secs no nos nr vol vols ch chap p pp par eq eqs ref refs art ed eds cf vs v approx ca al e.g i.e viz resp incl excl "
    "hr fr frl abb abs bd bzw evtl ggf inkl s sog vgl z.b d.h u.a i.d.r usf tab kap ziff str "
    "m mm mme mlle mgr env fig chap p.ex éd av apr art n tél "
    "sr sra srta dra ud uds ee pág págs núm art fig cap p.ej aprox ej tel "
    "см рис табл стр гл ср напр им ул д кв пр т.е т.н проф акад тов гр п пп "
    "डॉ श्री पृ सं د أ ص".split()
)
#: End a unit only where something that opens one follows.
CLOSE_ABBREVIATIONS = frozenset("etc usw a.m p.m u.s u.k e.u inc ltd co corp jr sr u.a.m т.д т.п др г гг в вв млн млрд тыс руб ee.uu uu min max int dept est jan feb mar apr jun jul aug sep sept oct nov dec".split())
MONTHS = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember january february march may june july october december "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre".split()
)
#: Before an ordinal in German.
ORDINAL_LEADS = frozenset("am der die das den dem des vom zum zur im bis ab seit beim ein eine einem einer eines jeder jede jedes jeden jedem und".split())
#: Words that open a unit, for gaps without a blank or a capital.
OPENERS = frozenset(
    "the a an in on at by for from with as is are was were does do did can could would should will how why what which who when where if it this that these those after before during since once most every apparently according oddly yes no now then here there we you they he she i "
    "der die das ein eine im am laut wie warum kannst ist welche siehe le la les un une il elle est pourquoi comment peux quel quelle selon el los las en cómo qué por según es ¿ "
    "в на как почему что если см".split()
)
#: Words that carry a quotation on to its reporting clause.
REPORTING = frozenset(
    "said says asked asks wrote writes replied replies answered answers added adds noted notes explained reported claimed and in was is or but then of on at from with as for to by "
    "fragte sagte schrieb antwortete meinte und demande dit écrit répond répondit et dijo dice preguntó escribió respondió y спросил сказал написал ответил и".split()
)
# Fixed values of the spaceless scripts: words by what they say about a gap beside them.
DICTIONARY = {
    # at the end of a sentence
    "final": "了 吗 嗎 呢 吧 啊 呀 嘛 的 た だ です ます でした ました ません か ね よ な わ る い ครับ ค่ะ คะ นะ จ้ะ ไหม มั้ย แล้ว เลย",
    # carry a quotation on to who says it
    "quote": "と って という といった",
    # lean on what stands before them, so that they open nothing
    "after": "と は が を の に も で という といった とは との って など 的",
    # leave open what stands before them
    "unfinished": "は が を に へ 在 把 被 和 与 跟 因为 如果 虽然 但 但是 可是 不过 しかし でも だが ถ้า เพราะ แต่ และ",
    # open a unit, or go on from a quotation
    "connects": "と言っても と言えば と言うのも と思いきや というのは というか というわけ というより",
    # may point back at a quotation
    "points": "这 這 那 一",
    "report": "问道 問道 说道 說道 写道 寫道 答道 喊道 叫道 问 問 说 說 道 写 寫 回答 答 表示 解释 補充 补充 喊 叫 追问 反问 提问 質問 聞 尋 訊 言 書 思 述べ 語 話し 呟 囁 ถาม กล่าว เขียน ตอบ พูด บอก ร้อง",
    "goes on": "然后 但 但是 可是 不过 而 就 才 并 又 却 所以 因此 于是 接着 还 也 そして それから しかし でも だが จากนั้น แต่ และ จึง ก็ แล้ว",
    "opens": (
        "为什么 怎么 怎样 在 由于 按照 根据 如果 当 没有 因为 虽然 今天 明天 昨天 后来 "
        "なぜ どうして どう どこ だれ いつ もし もう もっと もちろん もはや はい いいえ はじめ とても とにかく ところが ところで とりあえず とうとう ともかく としたら とすると "
        "それ これ あれ この その あの ここ そこ また まず まだ さて さらに つまり たとえば できれば できる がんばれ にわか のち のんびり 彼女 彼 私 ทำไม เมื่อ ถ้า เพราะ ตาม"
    ),
    # who is spoken to
    "whom": "我 你 您 他 她 它 我们 你们 他们 她们 着 著 过",
    # hold a letter or more of the words above and mean something else
    "word": (
        "知道 街道 道路 道理 报道 報道 渠道 通道 频道 轨道 味道 难道 小说 小說 传说 听说 据说 说法 疑问 学问 访问 顾问 問題 问题 疑問 学問 訪問 描写 编写 读写 叫做 目的 的确 等待 地方 得到 "
        "言葉 言語 方言 書類 書式 図書 読書 辞書 文書 新聞 思想 意思 不思議 物語 英語 日本語 単語 答案 一样 一起 那么 那里 这里 写真 คำตอบ คำถาม"
    ),
}
#: What speaks for the end of a unit at a gap of a spaceless script: above 0 it ends one. ``mark`` is where the count begins,
#: "said" the clause that reports what stands before; of the words behind the gap the strongest speaks.
WEIGHTS = {
    "full stop": {"mark": 7, "final": 1, "opens": 1, "goes on": -2, "points": -1, "after": -3},
    "question": {"mark": 4, "final": 1, "opens": 1, "connects": 1, "goes on": -2, "points": -1, "after": -3, "said": -6},
    "dot": {"mark": 2.5, "opens": 1, "goes on": -2, "points": -1, "after": -3},
    "ellipsis": {"mark": 0.5, "final": 1, "unfinished": -2, "opens": 1, "connects": -3, "goes on": -2, "points": -1, "after": -3},
    "quotation": {"mark": 3, "opens": 1, "connects": -4, "goes on": -2, "points": -4, "after": -4, "said": -6},
}

_EOL = "\n\r\x0b\x0c\x85  "
_FLAT = rf"[^\S{_EOL}]*"
#: Last five letters of the abbreviations that are as long.
_LONG_TAILS = frozenset(x[-5:] for x in OPEN_ABBREVIATIONS | CLOSE_ABBREVIATIONS if len(x) >= 5)
_BREAK = rf"[{_EOL}](?:(?<=\r)\n)?+"
_BLANK_LINE = re.compile(rf"{_BREAK}{_FLAT}(?:{_BREAK}{_FLAT})+")
_LINE = re.compile(_BREAK)
_ITEM = re.compile(r"[^\S\r\n]*(?:[-*+•‣◦▪–—·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][)]|[ivxIVX]{1,4}[)])[^\S\r\n]+(?=\S)")
_DOT_ITEM = re.compile(r"[^\S\r\n]*[a-z]\.[^\S\r\n]+(?=\S)")
_HEADING = re.compile(r"[^\S\r\n]*#{1,6}(?:[^\S\r\n]|$)")
_END_MARK = ".!?…。！？؟۔।॥｡‼⁇⁈⁉"
_CLOSER = "\"'”’»›)]}」』）】〉》〕］｝“"
_OPENER_OF = {"“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", "‚": "‘’", "［": "］", "〔": "〕"}
_BRACKETS = frozenset("([（【［〔")
_PAIRED = re.compile(r"[“”„«»‹›‘’‚「」『』()（）\[\]【】《》〈〉［］〔〕\"]")
_LOWER_GAP = re.compile(r"[^\W\d_]{5,}[.!?][\"”’»)]*[ ]+(?:" + "|".join(sorted(w for w in OPENERS if w.isalpha() and w not in ("el", "le", "is", "are"))) + r")[ ]")
_GAP = re.compile(r"[.!?…。！？؟۔।॥｡‼⁇⁈⁉]+")
_SPACE = re.compile(r"\s*")
_THAI_BLANK = re.compile(r"(?<=[ก-๛])[^\S\r\n]+(?=[ก-๛])|(?<=[ก-๛])[^\S\r\n]*\r?\n[^\S\r\n]*(?=[ก-๛])")
_THAI = re.compile(r"[ก-๛]")
_FRENCH_CLOSE = re.compile(r"[^\S\r\n][»›]")
_LETTERS_AND_DOTS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_TOKEN_BEFORE = re.compile(r"[^\s()\[\]“”«»„‘\":;,!?/]*$")
_WORD = re.compile(r"[^\W\d_]+")
_SPACELESS_RUN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿〇々ก-๛]+")
_CLAUSE_END = re.compile(r"[.!?…。！？؟۔।॥｡‼⁇⁈⁉：:]|(?<=[ก-๛])\s+(?=[ก-๛])")
_CLAUSE_PART = re.compile(r"[，,、；;]")
_HIRAGANA = re.compile(r"[ぁ-ゟ]+")
_ELLIPSIS = re.compile(r"\.\.\.+|…+")


def _han(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c in "〇々ー"


def _spaceless(c: str) -> bool:
    return _han(c) or "ก" <= c <= "๛"


def _pairs(text: str, s: int, e: int) -> list[tuple[int, int, bool]]:
    """Outermost quotations and brackets of a stretch: (open, close, is a bracket). What stays open is none."""
    marks = [(m.start(), m.group()) for m in _PAIRED.finditer(text, s, e)]
    if not marks:
        return []
    found: list[tuple[int, int, bool]] = []
    stack: list[tuple[int, str, str]] = []
    for at, c in marks:
        if c in "’'" and at + 1 < e and text[at + 1].isalnum() and at > s and text[at - 1].isalnum():
            continue  # an apostrophe
        if stack and c in stack[-1][2]:
            opened = stack.pop()
            found.append((opened[0], at, opened[1] in _BRACKETS))
            continue
        if c == '"':
            if any(o[1] == '"' for o in stack):
                while stack:
                    opened = stack.pop()
                    if opened[1] == '"':
                        found.append((opened[0], at, False))
                        break
            else:
                stack.append((at, c, '"'))
            continue
        if c in ")）]】］〕":  # an inner quotation that was never closed hides no bracket
            depth = next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][2]), None)
            if depth is not None:
                found.append((stack[depth][0], at, True))
                del stack[depth:]
            continue
        if c in _OPENER_OF:
            if c in "‘‚" and at > s and text[at - 1].isalnum():
                continue
            stack.append((at, c, _OPENER_OF[c]))
        elif c in "”»’』」":
            depth = next((k for k in range(len(stack) - 1, -1, -1) if c in stack[k][2]), None)
            if depth is not None:
                found.append((stack[depth][0], at, False))
                del stack[depth:]
    found.sort()
    outer: list[tuple[int, int, bool]] = []
    for p in found:
        if not outer or p[0] > outer[-1][1]:
            outer.append(p)
    return outer


@cache
def _dictionary() -> dict[str, list[tuple[str, frozenset[str]]]]:
    """Words with their classes, by first letter."""
    classes: dict[str, set[str]] = {}
    for kind, words in DICTIONARY.items():
        for w in words.split():
            classes.setdefault(w, set()).add(kind)
    found: dict[str, list[tuple[str, frozenset[str]]]] = {}
    for w, kinds in sorted(classes.items()):
        found.setdefault(w[0], []).append((w, frozenset(kinds)))
    return found


_NO_CLASS: frozenset[str] = frozenset()
#: Classes that speak where they stand before a gap.
_BEFORE = frozenset(("final", "unfinished"))
#: The least that the words beside a gap can leave, where nothing behind it reports.
_LEAST = {gap: w["mark"] + min(0, *(w.get(k, 0) for k in _BEFORE)) + min(x for k, x in w.items() if k not in _BEFORE | {"mark", "said"}) for gap, w in WEIGHTS.items()}


def lattice(text: str) -> list[tuple[int, int, frozenset[str]]]:
    """The cheapest path through the dictionary-word lattice of spaceless text: (start, end, classes) of its words.

    A dictionary word costs 1, a character outside every word 1.5; longer words win.
    """
    words = _dictionary()
    n = len(text)
    cost = [0.0] + [1e9] * n
    back: list[tuple[int, frozenset[str]]] = [(0, _NO_CLASS)] * (n + 1)
    for at, c in enumerate(text):
        here = cost[at]
        if here + 1.5 < cost[at + 1]:
            cost[at + 1], back[at + 1] = here + 1.5, (at, _NO_CLASS)
        for w, kinds in words.get(c, ()):
            end = at + len(w)
            if end <= n and here + 1 < cost[end] and text.startswith(w, at):
                cost[end], back[end] = here + 1, (at, kinds)
    path, at = [], n
    while at:
        start, kinds = back[at]
        path.append((start, at, kinds))
        at = start
    return path[::-1]


class _Stretch:
    """Running text between two blank lines, headings and items left out."""

    def __init__(self, text: str, s: int, e: int) -> None:
        self.text, self.s, self.e = text, s, e
        self.pairs = _pairs(text, s, e)
        self.opens = [p[0] for p in self.pairs]
        self.segmented: dict[int, dict[int, tuple[int, frozenset[str]]]] = {}

    @cached_property
    def lower(self) -> bool:
        """Whether units open in lower case here: the first does, or one does after a long word and its terminator."""
        first = _WORD.search(self.text, self.s, self.e)
        if first and first.group()[0].islower() and first.group() in OPENERS:
            return True
        return bool(_LOWER_GAP.search(self.text, self.s, self.e))

    @cached_property
    def runs(self) -> list[tuple[int, int]]:
        """(start, end) of the spaceless runs."""
        return [m.span() for m in _SPACELESS_RUN.finditer(self.text, self.s, self.e)]

    def words(self, at: int) -> dict[int, tuple[int, frozenset[str]]]:
        """(end, classes) by start, of the words of the whole run that ``at`` lies in; none outside a run."""
        k = bisect_right(self.runs, (at, len(self.text))) - 1
        if k < 0 or at >= self.runs[k][1]:
            return {}
        start, end = self.runs[k]
        if start not in self.segmented:
            self.segmented[start] = {start + a: (start + b, kinds) for a, b, kinds in lattice(self.text[start:end])}
        return self.segmented[start]

    def opening(self, at: int) -> frozenset[str]:
        """Classes of the word that begins at ``at``."""
        return self.words(at).get(at, (at, _NO_CLASS))[1]

    def closing(self, at: int) -> frozenset[str]:
        """Classes of the word that ends before ``at``."""
        words = self.words(at - 1)
        return next(reversed(words.values()), (at, _NO_CLASS))[1]

    def _clause_words(self, at: int, end: int) -> Iterator[tuple[int, int, frozenset[str]]]:
        while at < end:
            words = self.words(at)
            if not words:
                yield at, at + 1, _NO_CLASS
                at += 1
            while at < end and at in words:
                stop, kinds = words[at]
                yield at, stop, kinds
                at = stop

    def _reports(self, at: int) -> bool:
        """Whether the clause from ``at`` reports what was said: in a part of it only an ending or a pronoun follows a reporting verb."""
        m = _CLAUSE_END.search(self.text, at, self.e)
        if m and m.group() in "：:":
            return False  # it leads to what is said next
        end = m.start() if m else self.e
        for part in [*(x.start() for x in _CLAUSE_PART.finditer(self.text, at, end)), end]:
            reported = False
            for a, b, kinds in self._clause_words(at, part):
                if "report" in kinds:
                    reported = True
                elif not (kinds & {"final", "whom"} or _HIRAGANA.fullmatch(self.text, a, b)):
                    reported = False
            if reported:
                return True
            at = part + 1
        return False

    def _asks(self, at: int) -> bool:
        """Whether a quotative particle opens the clause from ``at`` and a reporting verb stands in it."""
        if "quote" not in self.opening(at):
            return False
        m = _GAP.search(self.text, at, self.e)
        return any("report" in kinds for _, _, kinds in self._clause_words(at, m.start() if m else self.e))

    def _weigh(self, gap: str, mark: int, nxt: int, said: bool) -> bool:
        """Whether a unit ends at a gap of a spaceless script, whose mark stands at ``mark`` and behind which ``nxt`` follows."""
        weights = WEIGHTS[gap]
        if not said and _LEAST[gap] > 0:
            return True  # no word outweighs the mark
        behind = [weights[k] for k in self.opening(nxt) - _BEFORE if k in weights]
        if said:
            behind.append(weights.get("said", 0))
        before = sum(weights.get(k, 0) for k in self.closing(mark) & _BEFORE)
        return weights["mark"] + before + max(behind, key=abs, default=0) > 0

    def _spaceless_gap(self, mark: str, blank: bool, before: str, c: str) -> str:
        """The kind of a gap in ``WEIGHTS``; empty where no spaceless script is concerned."""
        if not (_spaceless(before) or _spaceless(c)):
            return ""
        if mark[-1] in "。｡":
            return "full stop"
        if mark[-1] in "！？‼⁇⁈⁉" or mark[-1] in "!?" and _spaceless(c):
            return "question"
        if mark[0] == "…" or _ELLIPSIS.fullmatch(mark):
            return "ellipsis"
        if mark[-1] == "." and not blank and _han(c):
            return "full stop" if _han(before) else "dot"
        return ""

    def enclosing(self, at: int) -> tuple[int, int, bool] | None:
        k = bisect_right(self.opens, at) - 1
        return self.pairs[k] if k >= 0 and self.pairs[k][0] < at <= self.pairs[k][1] else None

    def ends(self) -> Iterator[int]:
        """Positions just past each unit but the last."""
        text, e = self.text, self.e
        unit = self.s
        at = self.s
        plain = not self.pairs
        thai = [m.start() for m in _THAI_BLANK.finditer(text, self.s, e)] if _THAI.search(text, self.s, e) else []
        cuts: list[int] = []
        while m := _GAP.search(text, at, e):
            at = m.end()
            if text[at : at + 1] == " " and text[at + 1 : at + 2].isupper() and text[at - 1] == ".":
                # the common gap: a dot after a long lower-case word, then a blank and a capital
                word = text[at - 6 : at - 1]
                if len(word) == 5 and word.isalpha() and word.islower() and word not in _LONG_TAILS and at - 6 >= self.s and (plain or not self.enclosing(at - 1)):
                    cuts.append(at)
                    unit = at
                    continue
            inside = None if plain else self.enclosing(m.start())
            if inside:
                close = inside[1]
                last = _SPACE.match(text, m.end(), e).end()
                if last < close:
                    continue  # not the last mark of what encloses it
                stop = close + 1
                while stop < e and text[stop] in _CLOSER and not text[stop] == "“":
                    stop += 1
                extra = _GAP.match(text, stop, e)
                if extra:
                    at = stop
                    continue  # judged at the mark behind
                if inside[2]:  # brackets: a unit only where they open one
                    at = stop
                    if inside[0] == _SPACE.match(text, unit, e).end() and self._opens(stop, m.group(), ""):
                        cuts.append(stop)
                        unit = stop
                    continue
                at = stop
                if self._after_quote(stop, inside[0] == _SPACE.match(text, unit, e).end(), inside[0], m.start()):
                    cuts.append(stop)
                    unit = stop
                continue
            stop = m.end()
            while stop < e and text[stop] in "\"'”’»›)]}」』）】":
                opener = bisect_right(self.opens, stop) - 1
                if text[stop] == '"' and opener >= 0 and self.opens[opener] == stop:
                    break
                stop += 1
            if (french := _FRENCH_CLOSE.match(text, stop, e)) and not self.enclosing(stop + 1):
                stop = french.end()
            if self._ends_unit(m, stop):
                cuts.append(stop)
                unit = stop
                at = stop
        if thai:
            cuts = sorted({*cuts, *(t for t in thai if not self.enclosing(t))})
        yield from cuts

    def _opens(self, stop: int, mark: str, token: str) -> bool:
        """Whether what follows ``stop`` opens a unit."""
        text, e = self.text, self.e
        nxt = _SPACE.match(text, stop, e).end()
        if nxt >= e:
            return True
        c = text[nxt]
        if c in ",;:—–-" and not (c in "—–-" and nxt + 1 < e and text[nxt + 1].isspace() and mark[-1] in "!?…."  and False):
            return False
        if c.islower():
            return self.lower or mark in ("?", "!", "?!", "!!") or bool(mark)
        return True

    def _after_quote(self, stop: int, leads: bool, opened: int, mark: int) -> bool:
        """Whether a unit ends with a quotation whose last character is a terminator, at ``mark``. leads: the unit began with it."""
        text, e = self.text, self.e
        nxt = _SPACE.match(text, stop, e).end()
        if nxt >= e:
            return True
        c = text[nxt]
        if c in ",;:—–，、；：-،":
            return False
        if _spaceless(c):
            return self._weigh("quotation", mark, nxt, leads and self._reports(nxt))
        if c.islower():
            word = _WORD.match(text, nxt, e)
            if not word:
                return False
            if word.group() in REPORTING:
                # a word that also opens units does so after a whole sentence in quotes that others introduced
                return self.lower and not leads and word.group() in OPENERS and len(text[opened:stop].split()) > 4
            return self.lower
        return True

    def _ends_unit(self, m: re.Match[str], stop: int) -> bool:
        text, s, e = self.text, self.s, self.e
        mark = m.group()
        nxt = _SPACE.match(text, stop, e).end()
        if nxt >= e:
            return True
        blank = nxt > stop
        c = text[nxt]
        before = text[m.start() - 1] if m.start() > s else " "
        if gap := self._spaceless_gap(mark, blank, before, c):
            if gap == "ellipsis" and c in ",;:—–，、；：":
                return False
            return self._weigh(gap, m.start(), nxt, gap == "question" and not blank and self._asks(nxt))
        if mark[-1] in "。！？｡؟۔।॥‼⁇⁈⁉":
            return True
        if not blank:
            return self._unspaced(m, stop, mark, before, c)
        if c in ",;:" or (c in "—–" and mark[-1] in ".…" and text[nxt + 1 : nxt + 2].isspace() and mark != "."):
            return False
        if _ELLIPSIS.fullmatch(mark):
            if not c.islower():
                return True
            rest = _GAP.search(text, nxt, e)
            words = text[nxt : rest.start() if rest else e].split()
            return self.lower and len(words) > 3 and words[0] in OPENERS
        if mark != ".":
            if c.islower():
                word = _WORD.match(text, nxt, e)
                return not (word and word.group() in REPORTING and word.group() not in OPENERS) if ".." not in mark else True
            return True
        if stop > m.end():  # closers behind the dot that belong to no pair
            return not c.islower() or self.lower
        token = _TOKEN_BEFORE.search(text, max(s, m.start() - 24), m.start()).group().lstrip(".’'-")
        low = token.lower()
        last = re.split(r"[’'-]", low)[-1] if low not in OPEN_ABBREVIATIONS else low
        pair = self._spaced_pair(m.start(), low)
        if pair in OPEN_ABBREVIATIONS:
            return False
        if pair in CLOSE_ABBREVIATIONS:
            return self._starts(nxt)
        if low in CLOSE_ABBREVIATIONS or last in CLOSE_ABBREVIATIONS:
            return self._starts(nxt)
        if low in OPEN_ABBREVIATIONS or last in OPEN_ABBREVIATIONS:
            return False
        if len(token) == 1 and token.isalpha():
            return False if token.isupper() or c.islower() else True
        if _LETTERS_AND_DOTS.fullmatch(token):
            return self._starts(nxt)
        if token.isdigit() and len(token) <= 2 and not c.isdigit():
            word = _WORD.match(text, nxt, e)
            lead = _WORD.findall(text[max(s, m.start() - len(token) - 14) : m.start() - len(token)])
            if word and word.group().lower() in MONTHS:
                return False
            if word and lead and lead[-1].lower() in ORDINAL_LEADS and word.group().lower() not in OPENERS:
                return False
        return True

    def _starts(self, nxt: int) -> bool:
        """Whether a unit starts here, after an abbreviation that may end one."""
        c = self.text[nxt]
        if c.islower() or c.isdigit():
            return False
        if c.isupper():
            word = _WORD.match(self.text, nxt, self.e)
            return bool(word)
        return c in "¿¡“„«‘(\"「『（" or not c.isascii()

    def _spaced_pair(self, dot: int, low: str) -> str:
        """Abbreviations written with a blank, like "z. B." or "т. д.": both letters joined."""
        if len(low) > 2 or not low:
            return low
        m = re.search(r"(?<![\w.])(\w{1,2})\.[   ]?" + re.escape(low) + r"$", self.text[max(self.s, dot - 8) : dot], re.I)
        return f"{m.group(1).lower()}.{low}" if m else low

    def _unspaced(self, m: re.Match[str], stop: int, mark: str, before: str, c: str) -> bool:
        """Gaps without a blank: file names and numbers end nothing, a capital after a word does."""
        text, s, e = self.text, self.s, self.e
        if _han(c):
            return True
        if c.isdigit() or not c.isalpha() and c not in "¿¡“„«‘\"(「":
            return False
        if not c.isalpha():
            return before.isalnum() or mark != "."
        word = _WORD.match(text, stop, e).group()
        if c.isupper():
            token = _TOKEN_BEFORE.search(text, max(s, m.start() - 24), m.start()).group()
            if len(token) == 1 and token.isalpha() or re.search(r"(?:^|[^\w])[^\W\d_](?:\.[^\W\d_])*$", token):
                return False
            if mark == "." and token.lower() in OPEN_ABBREVIATIONS:
                return False
            return len(word) == 1 or not word.isupper() or mark != "."
        if not c.islower():  # scripts without case
            return mark != "." or not c.isascii()
        if mark != ".":
            return self.lower or mark[-1] in "!?" and word.lower() in OPENERS
        follow = text[stop + len(word) : stop + len(word) + 1]
        return self.lower and word in OPENERS and follow == " " and (before.isalnum())


def _lines(text: str, s: int, e: int) -> list[tuple[int, int]]:
    if "\n" not in text[s:e] and "\r" not in text[s:e]:
        return [(s, e)] if text[s:e].strip() else []
    lines, at = [], s
    for m in _LINE.finditer(text, s, e):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, e))
    return [x for x in lines if text[x[0] : x[1]].strip()]


def _bare_heading(text: str, lines: list[tuple[int, int]], k: int) -> bool:
    """A first line without a mark that stands alone: it ends early for no reason of wrapping."""
    s, e = lines[k]
    line = text[s:e].strip()
    if k or len(lines) < 2 or len(line) > 60 or line[-1] in _END_MARK + ",;:" or not line[0].isupper():
        return False
    follow = text[slice(*lines[1])].strip()
    if not follow or not (follow[0].isupper() or follow[0] in "¿¡“„«‘("):
        return False
    width = max(len(text[a:b].strip()) for a, b in lines)
    return len(line) + 1 + len(follow.split()[0]) <= min(width, 80) - 8 and len(line.split()) <= 8 and len(lines) >= 2 and width - len(line) > 20 and not any(
        _ITEM.match(text, a, b) for a, b in lines
    ) and len(text[slice(*lines[1])].strip()) > 60


def _stretches(text: str, s: int, e: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of the headings and items of a block (whole: one unit) and its running text."""
    lines = _lines(text, s, e)
    if not lines:
        return
    if len(lines) == 1:
        a, b = lines[0]
        yield a, b, bool(_HEADING.match(text, a, b) or _ITEM.match(text, a, b))
        return
    run: int | None = None
    item: tuple[int, int] | None = None
    end = s
    items = sum(bool(_ITEM.match(text, a, b)) for a, b in lines)
    for k, (a, b) in enumerate(lines):
        heading = bool(_HEADING.match(text, a, b)) or _bare_heading(text, lines, k)
        marked = _ITEM.match(text, a, b)
        if marked and run is not None and item is None and text[a:b].lstrip()[0] in "–—-" and items < 2:
            marked = None  # a dash inside a paragraph
        if marked and run is not None and marked.group().strip()[:-1].isdigit() and items < 2 and text[run:end].rstrip()[-1] not in _END_MARK + ":":
            marked = None  # a number that a wrapped line happens to begin with
        if heading or marked:
            if item:
                yield *item, True
                item = None
            elif run is not None:
                yield run, end, False
            run = None
            if heading:
                yield a, b, True
            else:
                item = (a, b)
        elif item:
            item = (item[0], b)
        elif run is None:
            run = a
        end = b
    if item:
        yield *item, True
    elif run is not None:
        yield run, end, False


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, in code points, without blanks around."""
    if not text or text.isspace():
        return []
    found: list[tuple[int, int]] = []

    def add(s: int, e: int) -> None:
        piece = text[s:e]
        left = len(piece) - len(piece.lstrip())
        right = len(piece.rstrip())
        if right > left:
            found.append((s + left, s + right))

    at = 0
    blocks = []
    for m in _BLANK_LINE.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    for s, e in blocks:
        for a, b, whole in _stretches(text, s, e):
            if whole:
                add(a, b)
                continue
            start = a
            for cut in _Stretch(text, a, b).ends():
                add(start, cut)
                start = cut
            add(start, b)
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        for i, text in enumerate(b.column(1).to_pylist()):
            for s, e in units(text):
                rows.append(i)
                starts.append(s)
                ends.append(e)
        ids = b.column(0).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "start_pos", "end_pos"])


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every sentence unit."""
    return documents.select("doc_id", "text").where("text is not null").mapInArrow(_scan, "doc_id bigint, start_pos bigint, end_pos bigint")
