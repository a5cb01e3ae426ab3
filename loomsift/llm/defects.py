"""Broken prompt and response pairs (problem 4).

Copies are found by compressing the answer with the question as a zstandard dictionary:
an answer that costs next to nothing is a candidate, and an exact comparison of words
confirms it. Refusals and languages come from dictionaries, truncation from a model of
terminal contexts: how often each trigram of letters ends a word, counted over every
answer that ends with a full stop, and words that never end anything.

An answer has one defect at most, in the order empty, refusal, echo, wrong_language,
truncated. A null answer is empty. A null question has no language and no copy. Texts
of any length are read whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.mojibake import repair
from loomsift.llm.sentences import OPEN_ABBREVIATIONS
from loomsift.session import written

#: A word looks broken off where its last trigram stands inside words more than this many times as often as at their end.
INSIDE = 12
#: Characters of answers whose words a task counts before it hands on their trigrams; this bounds its memory, not the counts.
COUNTED_AT_ONCE = 1 << 24

# Words that stand for no answer.
NO_ANSWER = frozenset(
    "n/a na none null nil nan undefined empty blank missing tbd todo void noanswer noresponse nooutput notavailable notapplicable noreply "
    "keineantwort keine leer sansréponse aucuneréponse vide sinrespuesta ninguna vacío нетответа нет пусто 无 暂无 无回答 没有答案 空 なし".split()
)
# Phrases that decline, by language; a sentence that holds one declines.
DECLINES = re.compile(
    r"\b(?:i(?:[’']m| am) (?:not able|unable|not allowed|not permitted|not in a position|afraid (?:that )?i can(?:no|[’'])t)|i (?:can(?:[’']t|not)|could not|couldn[’']t|won[’']t|will not) (?:help|assist|answer|respond|provide|comply|discuss|write|create|generate|fulfil+|do that|share|be writing|be able|be answering|be providing|be discussing|continue with|support)"
    r"|i (?:have to|must|need to) (?:decline|refuse|pass)|i (?:decline|refuse) to|i(?:[’']d| would) (?:rather|prefer) not|must decline|(?:against|violates?) (?:my|our|the) (?:guidelines|policy|policies|rules)|not be appropriate for me|do(?:n[’']t| not) have (?:the )?permission|not something i can|beyond what i can|no permission to|cannot comply|unable to (?:help|assist|answer|provide|comply))"
    r"|nicht (?:weiter)?helfen|nicht beantworten|(?:ablehnen|verweigern)\b|nicht in der lage|darf ich\b[^.!?]*\b(?:nichts|nicht|keine)|ich darf\b[^.!?]*\b(?:nichts|nicht|keine)|keine auskunft|nicht möglich, (?:darauf|dazu)|verstößt gegen|kann ich (?:leider )?(?:nicht|keine)|nicht befugt|nicht erlaubt"
    r"|pas autorisée?|(?:ne peux|ne puis) pas (?:répondre|aider|vous aider|t[’']aider|fournir|traiter|donner|en parler)|je dois (?:refuser|décliner)|m[’']est impossible|je refuse|contraire à mes|pas en mesure|ne suis pas habilité"
    r"|no puedo (?:ayudar|responder|contestar|proporcionar|hablar|dar|atender|cumplir)|no estoy autorizad[oa]|debo (?:rechazar|declinar)|no me es posible|me niego|va en contra de mis|no tengo permiso|no soy capaz"
    r"|не могу (?:помочь|ответить|обсуждать|предоставить|говорить|выполнить)|мне нельзя|вынужден\w* отказ|отказаться от ответа|не имею права|не вправе|отказываюсь|противоречит (?:моим|правилам)|невозможно ответить"
    r"|无法(?:回答|帮助|提供|协助|讨论|满足)|不能(?:提供|回答|帮助|协助|讨论|透露)|必须拒绝|不得不拒绝|拒绝(?:回答|这个)|没有权限|无权|不便回答|不方便(?:回答|透露)|不允许"
    r"|お答えできません|お手伝いできません|お断り|対応できません",
    re.I,
)
# What may stand around a refusal without making it an answer.
COURTESY = re.compile(
    r"^(?:(?:i[’']?m|i am|we[’']?re)? ?(?:so |very |really )?sorry\b.{0,20}|i apologi[sz]e\b.{0,12}|apologies\b.{0,20}|unfortunately|as an (?:ai|assistant)\b.{0,40}|thank(?:s| you)\b.{0,30}|please (?:contact|ask|consult|try|reach|see|talk)\b.{0,50}|try (?:a|another|something)\b.{0,30}|is there (?:anything|something)\b.{0,40}|let me know\b.{0,50}|can i help\b.{0,40}|feel free\b.{0,50}"
    r"|es tut mir leid.{0,10}|leider|entschuldig.{0,20}|tut mir leid.{0,20}|bitte (?:wende|frag|kontaktier|versuch)\w*\b.{0,50}|kann ich sonst.{0,30}|gibt es sonst.{0,30}|versuch\w* .{0,30}"
    r"|(?:je suis )?désolée?.{0,20}|malheureusement|pardon|puis-je .{0,40}|veuillez .{0,50}|adressez-vous .{0,50}|essayez .{0,40}|merci.{0,30}"
    r"|lo siento.{0,10}|lamentablemente|por desgracia|perdona.{0,10}|¿?necesitas .{0,30}|¿?puedo .{0,30}|consulta .{0,40}|prueba .{0,40}|contacta .{0,40}|gracias.{0,30}"
    r"|к сожалению|извините.{0,10}|простите.{0,10}|обратитесь .{0,40}|попробуйте .{0,40}|спросите .{0,40}|спасибо.{0,20}"
    r"|很抱歉|对不起|抱歉|请换.{0,12}|请咨询.{0,12}|请联系.{0,12}|还有.{0,16}|谢谢.{0,8}|申し訳.{0,12})[\s,.!?;:，。！？]*$",
    re.I,
)
# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that each despite every there often so slower inside roughly about without any it for on with as was by be at from this are or an not have has which when how why what can does do you we since during before after because whether if under near until most once no longer both between next according",
    "de": "etwa ungefähr beiden langsameren der die das und ist von zu den mit nicht ein eine einer dem des im auf für sich bei nach aus dass wie ob wir wird sind oder an seit während wegen ohne jede bis zwischen trotz unter gemäß neben außerhalb kannst kurz vor wenn auch sehen warum welche",
    "fr": "deux dès près cas lentes le la les des du de et est un une que qui dans pour sur avec ne pas au aux ce se par en il elle nous vous sans depuis pendant entre après avant jusqu chaque malgré sous selon où pourquoi comment quel hors côté cause dès",
    "es": "dos casi unos hay lento lentas ambos el la los las de del y es un una que en para con no se por su al lo como más sin desde durante entre después hasta cada según bajo pesar junto qué cómo cuando cuanto ajuste decide puedes hay",
    "it": "il lo gli della che di e è un una per con non si del dei nel alla sono questo anche",
    "pt": "o os as da do e é um uma que em para com não se por dos das no na ao mais como",
    "nl": "de het een en van is dat op te in voor met niet zijn aan er ook maar bij naar",
}
_SHARED = {w for w, n in Counter(w for v in FUNCTION_WORDS.values() for w in set(v.split())).items() if n > 1}
#: Function words of one language only.
_FUNCTION_SETS = {k: frozenset(v.split()) - _SHARED for k, v in FUNCTION_WORDS.items()}
#: Letters and endings of one language. Fixed values.
_MARKS = {
    "es": re.compile(r"[¿¡ñ]|(?<=[a-zóíáéú]{3})(?:ción|dad|ado|ada|idos|idas|ida|ido)\b"),
    "fr": re.compile(r"[çœêèùâîô]|(?<=[a-zéè]{2})(?:ée|ées|és|é)\b"),
    "de": re.compile(r"[äöüß]|(?<=[a-zäöü]{3})(?:ung|keit|heit|lich)\b"),
}
_LATIN = re.compile(r"[a-zß-öø-ÿœ]+")
_ELIDED = re.compile(r"\b(?:l|d|qu|n|j|jusqu)[’'](?=[a-zß-öø-ÿœ])")
_SCRIPTS = {"ru": re.compile(r"[Ѐ-ӿ]+"), "ar": re.compile(r"[؀-ۿ]+"), "hi": re.compile(r"[ऀ-ॿ]+"), "th": re.compile(r"[฀-๿]{1,6}"), "ko": re.compile(r"[가-힣]+")}
_OTHER_SCRIPT = re.compile(r"[\u0400-\u1fff\u3040-\ud7ff]")
_HAN = re.compile(r"[㐀-鿿]+")
_KANA = re.compile(r"[぀-ヿ]")
#: Languages named when a question asks for one. Fixed values.
ASKS_LANGUAGE = re.compile(
    r"\b(?:in|into|to|auf|ins|en|al|a|in das) ?(?:english|german|french|spanish|russian|chinese|japanese|italian|portuguese|dutch|arabic|hindi|korean|englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|russisch\w*|chinesisch\w*|anglais\w*|allemand\w*|français\w*|espagnol\w*|russe|chinois\w*|inglés|alemán|francés|español|ruso|chino)\b"
    r"|\btranslate\b|\bübersetze?\b|\btraduis\w*\b|\btraduisez\b|\btraduce\b|\btraduzca\b|по-(?:английски|немецки|французски|испански|русски|китайски)|на (?:английск|немецк|французск|испанск|русск|китайск)\w+ язык|на (?:английском|немецком|французском|испанском|русском|китайском)|переведи"
    r"|用(?:英|中|法|德|俄|日|西班牙|英语|中文)\w*?(?:文|语)?(?:回答|回复|作答|写)|翻译(?:成|为)|(?:英|法|德|俄|日|西班牙)(?:文|语)(?:回答|回复|作答)",
    re.I,
)
# Words that end no clause.
DANGLING = frozenset(
    "the a an of and or but because which whose that to for with by in on at from as than if when while where so nor into onto per via about between "
    "der die das den dem des ein eine einen einem einer und oder aber weil dass ob wenn mit von für zu zum zur im am auf aus bei nach deren dessen sowie "
    "le la les un une des du de et ou mais que qui dont parce car avec pour sur dans par au aux sans si où quand comme "
    "el los las una unos unas del al y o pero porque que quien cuyo cuya cuyos cuyas con para por en sin si cuando como donde "
    "и или но что который которая которое которые потому поскольку если с для в на из по от до к чтобы когда где а".split()
)
DANGLING_HAN = ("因为", "以及", "并且", "而且", "或者", "但是", "所以", "如果", "其中", "和", "与", "的", "把", "被", "对", "从", "在", "向", "及", "或", "而", "但")

_FENCE = re.compile(r"```")
_CODE = re.compile(r"```.*?(?:```|$)", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)*")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_INVISIBLE = re.compile(r"[​‌‍⁠﻿­᠎]")
_TERMINAL = re.compile(r"[.!?。！？…؟।॥‼⁇⁈⁉][\"'”’»›)\]}」』）】*_`~ ]*$")
_WHOLE = tuple(".!?。！？")
_LAST_TOKEN = re.compile(r"([\w.]+)\.$")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+\S")
_BARE_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s*$")
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*|[.!?。！？]+")
_LABEL = re.compile(r"^\W*(?:question|instruction|prompt|user|human|query|q|input|task|frage|aufgabe|pregunta|instrucción|question posée|consigne|вопрос|задание|问题|问|提示|指令)\s*[:：.)-]\s*", re.I)


def tokens(text: str) -> list[str]:
    """Words of a text, case folded; ideographs and kana one by one."""
    return _TOKEN.findall(text.casefold())


def is_empty(answer: str | None) -> bool:
    """Null, blank, or nothing but a mark or word that stands for no answer."""
    if answer is None:
        return True
    plain = _INVISIBLE.sub("", answer).strip()
    if not any(map(str.isalnum, plain)):
        return True
    return len(plain) < 30 and re.sub(r"[^\w/]|_", "", plain.lower()) in NO_ANSWER


def is_refusal(answer: str) -> bool:
    """A sentence declines, and besides it stands nothing but courtesies."""
    left, declined = 0, False
    for m in _SENTENCE.finditer(answer):
        sentence = m.group().strip()
        if not sentence:
            continue
        if DECLINES.search(sentence):
            declined = True
        elif not COURTESY.match(sentence):
            left += len(tokens(sentence))
            if left > 3:
                return False
    return declined


def _compressed(answer: bytes, question: bytes) -> int:
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(question, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False)
    return len(packer.compress(answer))


def _near(a: list[str], b: list[str], most: int) -> bool:
    """Whether at most ``most`` words must go from or come to one list to get the other, words compared in order."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    lo = 0
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    n, m = len(a), len(b)
    far = {1: 0}  # by diagonal, how far into a the words agree after so many changes
    for changes in range(most + 1):
        for k in range(-changes, changes + 1, 2):
            x = far[k + 1] if k == -changes or (k < changes and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            far[k] = x
            if x >= n and x - k >= m:
                return True
    return False


def _repeats(said: int, once: int, slack: int) -> range:
    """How often ``once`` words may stand in ``said`` words, where ``slack`` and one more for each repeat may differ."""
    most = (said + slack - 1) // (once - 1) if once > 1 else said + slack
    return range(max(1, -(-(said - slack + 1) // (once + 1))), max(1, most) + 1)


def is_echo(answer: str, question: str, extra: str) -> bool:
    """The question and nothing else: again, with its input, in other formatting, with a label or with a word missing."""
    said = tokens(_LABEL.sub("", answer.strip()))
    asked, given = tokens(question), tokens(extra)
    if not asked or not said or len(said) < 0.5 * len(asked):
        return False
    plain, source = " ".join(said).encode(), " ".join(asked + given).encode()
    # in a short text the frame, or one word that is new, takes up much of the room
    fresh = set(said).difference(asked, given)
    new = 12 + sum(len(w.encode()) + 1 for w in fresh) if len(plain) <= 60 else 0
    if _compressed(plain, source) > 24 + len(plain) // 12 + new:
        return False
    whole = ([], given) if given else ([],)
    for more in whole:
        for once in ((asked + more), (more + asked)) if more else (asked,):
            if len(asked) <= 4:
                if len(said) % len(once) == 0 and said == once * (len(said) // len(once)):
                    return True
                continue
            slack = max(1, min(3, len(asked) // 12))
            for times in _repeats(len(said), len(once), slack):
                # many repeats leave much room in all; an answer among them brings more new words than three do
                if times > 3 and len(fresh) > slack + 2:
                    break
                if _near(said, once * times, slack + times - 1):
                    return True
    labels = [w for w in said if w not in set(asked + given)]
    if 0 < len(labels) <= 4 and len(asked) > 6:  # labels inside, such as one before the input
        rest = [w for w in said if w not in set(labels)]
        return any(_near(rest, x, 1) for x in (asked, asked + given, asked * max(1, round(len(rest) / len(asked)))))
    return False


def languages(text: str) -> Counter[str]:
    """Evidence by language: different function words of Latin-script languages, letters of other scripts.

    Letters and endings of one language are counted where the words leave it open.
    """
    found: Counter[str] = Counter()
    low = text.lower()
    words = set(_LATIN.findall(low))
    for language, known in _FUNCTION_SETS.items():
        if not words.isdisjoint(known):
            found[language] = len(words & known)
    top = sorted(found.values(), reverse=True)[:2]
    if sum(top) < 4 or (len(top) > 1 and top[1] * 3 > top[0]):
        for language, mark in _MARKS.items():
            if n := len(mark.findall(low)):
                found[language] += min(n, 2 + found[language])
        found["fr"] += len(_ELIDED.findall(low))
    if _OTHER_SCRIPT.search(low):
        for language, letters in _SCRIPTS.items():
            if n := len(letters.findall(low)):
                found[language] = n
        if han := sum(map(len, _HAN.findall(low))):
            kana = len(_KANA.findall(low))
            found["ja" if kana * 4 > han else "zh"] += (han + kana + 1) // 2
    return +found


def main_language(text: str) -> tuple[str | None, float]:
    """(language, its share of the evidence); None where the text shows none."""
    found = languages(_CODE.sub(" ", text) if "```" in text else text)
    if not found:
        return None, 0.0
    (best, n), *_ = found.most_common(1)
    rival = max((v for k, v in found.items() if k != best), default=0)
    return best, n / (n + rival)


def is_other_language(answer: str, question: str, extra: str) -> bool:
    """All or nearly all of the answer is in another language than the question, which asks for none."""
    theirs, _ = main_language(question)
    if theirs is None:
        return False
    own, share = main_language(answer)
    if own is None or own == theirs:
        return False
    found = languages(_CODE.sub(" ", answer))
    if found[own] < 2 or share < 0.6:
        return False
    strange = found[theirs] <= 0.34 * found[own] or (own in ("zh", "ja", "ru", "ar", "hi", "th", "ko") and found[theirs] <= 0.5 * found[own])
    return strange and not ASKS_LANGUAGE.search(f"{question}\n{extra}")


def _ending(word: str) -> str | None:
    """The trigram by which a word is judged; none for short words and for scripts without blanks, whose runs of letters are no words."""
    w = word.lower()
    if len(w) < 3 or not w.isalpha() or w[0] >= "Ӏ" or max(w[-3:]) >= "Ӏ":
        return None
    return w[-3:]


class Endings:
    """How often a trigram of letters ends a word, against how often it stands inside one."""

    def __init__(self, texts: Iterable[str] = ()) -> None:
        self.final: Counter[str] = Counter()
        self.inner: Counter[str] = Counter()
        words: Counter[str] = Counter()
        for text in texts:
            words.update(_WORD.findall(text.lower()))
        self.count(words)

    def count(self, words: Counter[str]) -> None:
        """Adds words in lower case, each as often as it stands."""
        for w, n in words.items():
            self.final[w[-3:]] += n
            for i in range(len(w) - 3):
                self.inner[w[i : i + 3]] += n

    def cut(self, word: str) -> bool:
        """Whether a word looks broken off."""
        w = _ending(word)
        return w is not None and self.final[w] * INSIDE < self.inner[w]


class _Asked:
    """In the place of a model that is still being counted: holds every word for broken off and keeps the trigrams asked for."""

    def __init__(self) -> None:
        self.trigrams: list[str] = []

    def cut(self, word: str) -> bool:
        w = _ending(word)
        if w is not None:
            self.trigrams.append(w)
        return w is not None


def is_truncated(answer: str, endings: Endings | _Asked) -> bool:
    """Breaks off inside a sentence, list or code block."""
    text = _INVISIBLE.sub("", answer).rstrip().rstrip("*_~").rstrip()
    if not text:
        return False
    if len(_FENCE.findall(text)) % 2:
        return True
    if text.endswith("```"):
        return False
    lines = text.split("\n")
    last = lines[-1]
    if _BARE_ITEM.match(last) and len(lines) > 1:
        return True
    item = bool(_ITEM.match(last))
    if _TERMINAL.search(text[-16:]):
        token = _LAST_TOKEN.search(text[-40:])
        return bool(token and token.group(1).lower() in OPEN_ABBREVIATIONS and token.group(1).lower() not in ("no", "s", "m", "p", "st", "art", "a", "u") and len(tokens(text)) > 4)
    if text[-1] in ",;:，；：、([{（«„“‘—–-" and len(tokens(text)) > 2:
        return True
    if text[-1] in ")]}）」』»”\"'’*":
        return text[-1] in "”\"'’»" and False
    words = tokens(last if item else text)
    if not words:
        return False
    end = words[-1]
    tail = last.rstrip()
    if end in DANGLING or any(tail.endswith(h) for h in DANGLING_HAN if item or len(words) > 2):
        return len(words) > 1
    if item:
        letters = _WORD.findall(last)
        return bool(letters and last.rstrip().endswith(letters[-1]) and endings.cut(letters[-1]))
    if len(words) <= 5 and not re.search(r"[.!?]\s|[。！？]", text) and "，" not in text:
        return False
    return bool(re.search(r"[^\W_]", text[-1]) or text[-1] in "%€$°")


def defect(answer: str | None, question: str | None, extra: str | None, endings: Endings | _Asked) -> str | None:
    """The defect of an answer, or none."""
    if is_empty(answer):
        return "empty"
    question, extra = question or "", extra or ""
    if is_refusal(answer):
        return "refusal"
    if question and is_echo(answer, question, extra):
        return "echo"
    other = bool(question) and is_other_language(answer, question, extra)
    cut = not other and is_truncated(answer, endings)
    if other or cut:  # damaged characters may only look like another language or an open end
        plain, damaged, lost = repair(answer)
        if damaged:
            other = bool(question) and is_other_language(plain, question, extra)
            cut = not other and is_truncated(plain, endings) and not (lost and not plain[-1].isascii())
    return "wrong_language" if other else "truncated" if cut else None


def conversation_answer(text: str | None) -> tuple[str | None, str | None, bool]:
    """(question, answer, whether the text is a conversation) of a conversation's JSON text."""
    try:
        turns = json.loads(text) if text else None
    except (ValueError, RecursionError):
        turns = None
    if not isinstance(turns, list):
        return None, text, False
    turns = [t for t in turns if isinstance(t, dict)]
    role = lambda t: str(t.get("role") or t.get("from") or "").strip().lower()
    said = lambda t: t.get("content", t.get("value"))
    at = max((i for i, t in enumerate(turns) if role(t) in ("assistant", "gpt")), default=None)
    if at is None:
        return None, None, True
    asked = [said(t) for t in turns[:at] if role(t) in ("user", "human") and isinstance(said(t), str)]
    answer = said(turns[at])
    return asked[-1] if asked else None, answer if isinstance(answer, str) else None, True


def _answers(b: pa.RecordBatch) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(question, extra, answer) of each row, the last answer where a row holds a conversation."""
    columns = [b.column(i).to_pylist() for i in range(3, 6)]
    for question, extra, answer in zip(*columns, strict=True):
        if question is None and extra is None and answer is not None and answer.lstrip()[:1] == "[":
            question, answer, _ = conversation_answer(answer)
        yield question, extra, answer


def _scan(endings: Endings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds = [], []
            for i, (question, extra, answer) in enumerate(_answers(b)):
                kind = defect(answer, question, extra, endings)
                if kind:
                    rows.append(i)
                    kinds.append(kind)
            keys = b.select(_KEYS).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(kinds, pa.string())], [*_KEYS, "defect"])

    return run


_KEYS = ["table_name", "line_no", "field_name"]
_FOUND = "table_name string, line_no bigint, field_name string, defect string"
#: Of a first pass: defects with the first and last trigram they hang on, and counts of trigrams, in rows of their own.
_READ = f"{_FOUND}, asked string, asked_last string, trigram string, final bigint, inner bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _READ.split(", ")]
    words: Counter[str] = Counter()
    letters = 0

    def counts() -> pa.RecordBatch:
        model = Endings()
        model.count(words)
        # a trigram that nothing can ask for is not handed on
        seen = sorted(x for x in model.final.keys() | model.inner.keys() if _ending(x))
        blank = [pa.nulls(len(seen), pa.int64() if x == "line_no" else pa.string()) for x in names[:6]]
        sums = [pa.array([c[x] for x in seen], pa.int64()) for c in (model.final, model.inner)]
        return pa.RecordBatch.from_arrays([*blank, pa.array(seen, pa.string()), *sums], names)

    for b in batches:
        rows, kinds, first, last = [], [], [], []
        for i, (question, extra, answer) in enumerate(_answers(b)):
            asked = _Asked()
            kind = defect(answer, question, extra, asked)
            if kind:
                rows.append(i)
                kinds.append(kind)
                first.append(asked.trigrams[0] if asked.trigrams else None)
                last.append(asked.trigrams[-1] if asked.trigrams else None)
            if answer and answer.rstrip().endswith(_WHOLE):
                words.update(_WORD.findall(answer.lower()))
                letters += len(answer)
            if letters >= COUNTED_AT_ONCE:
                yield counts()
                words.clear()
                letters = 0
        keys = b.select(_KEYS).take(pa.array(rows, pa.int64()))
        blank = [pa.nulls(len(rows), x) for x in (pa.string(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*keys.columns, *(pa.array(x, pa.string()) for x in (kinds, first, last)), *blank], names)
    yield counts()


def defects(answers: DataFrame, endings: Endings | None = None) -> DataFrame:
    """(table_name, line_no, field_name, defect) of every defective answer.

    ``answers`` has table_name, line_no, field_name, question, extra and answer; where question and
    extra are null, the answer may be the JSON text of a whole conversation.

    Without ``endings`` the terminal model is counted over all answers that end with a full stop, in
    the pass that looks for defects. A defect that hangs on the model stands if every trigram asked
    for (one, or one more for the repaired text) proves to be broken off, else there is none.
    """
    some = answers.select(*_KEYS, "question", "extra", "answer")
    if endings is not None:
        return some.mapInArrow(_scan(endings), _FOUND)
    read = written(some.mapInArrow(_read, _READ), "answers")
    sums = read.where("trigram is not null").groupBy("trigram").agg(F.sum("final").alias("final"), F.sum("inner").alias("inner"))
    cut = sums.where(F.col("final") * INSIDE < F.col("inner")).select("trigram")
    open_ends = read.where("asked is not null")
    for asked in ("asked", "asked_last"):
        open_ends = open_ends.join(cut.withColumnRenamed("trigram", asked), asked, "left_semi")
    sure = read.where("defect is not null and asked is null")
    return sure.select(*_KEYS, "defect").unionByName(open_ends.select(*_KEYS, "defect"))
