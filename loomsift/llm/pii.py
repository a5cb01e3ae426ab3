"""Personal information inside free text (problem 1).

An Aho-Corasick automaton finds anchors: at-signs, identifier cues, street and
post-box words, titles, salutations and listed names. At each anchor a
deterministic parser expands and validates the boundaries of one item. Phones have
no anchors: a pattern scans texts that hold a long number, as bare numbers count as
well. Items never overlap: e-mail addresses win, then identifiers, addresses, phones
and names.

Null and empty texts hold no items; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
RANK = {"email": 0, "id_number": 1, "address": 2, "phone": 3, "name": 4}


class Item(NamedTuple):
    start: int
    end: int
    kind: str


# The cue words of each kind, lower case.
AT_CUES = ("@", "(at)", "[at]", "{at}", " at ", "＠")
ID_CUES = (
    "passport", "driver's licence", "driver's license", "driver’s licence", "driver’s license", "driving licence", "driving license", "ssn", "social security", "tax id",
    "tax number", "taxpayer", "id card", "identity card", "national id", "national insurance", "identity number", "identification number",
    "ausweis", "reisepass", "steuer-id", "steuernummer", "steueridentifikation", "sozialversicherung", "führerschein", "personalausweis",
    "sécurité sociale", "carte d’identité", "carte d'identité", "passeport", "numéro fiscal", "permis de conduire", "pièce d’identité",
    "dni", "pasaporte", "número de identidad", "documento de identidad", "seguridad social", "permiso de conducir", "carné de conducir", "nie", "nif",
    "паспорт", "инн", "снилс", "водительск", "удостоверени", "страхов", "护照", "身份证", "社保", "社会保障", "税号", "驾照", "驾驶证", "纳税",
)
PHONE_CUES = ("+", "00", "tel", "tél", "phone", "call", "mob", "whatsapp", "text", "电话", "请打", "тел", "звон", "номер")
BOX_CUES = ("po box", "p.o. box", "p. o. box", "post office box", "postfach", "boîte postale", "bp ", "apartado", "apdo", "а/я", "абонентский ящик", "邮政信箱", "信箱")
STREET_CUES = {
    "en": (" street", " st.", " st ", " st,", " road", " rd", " lane", " ln", " avenue", " ave", " court", " ct", " drive", " terrace", " square", " crescent", " close", " boulevard", " blvd", " place", " quay", " row ", " row,", " way ", " way,", " gardens", " highway"),
    "de": ("straße", "strasse", "str.", "allee", "weg ", "platz ", "gasse", "ufer ", "damm "),
    "fr": (" rue ", " impasse ", " allée ", " avenue ", " av. ", " boulevard ", " bd ", " place ", " chemin ", " cours ", " quai ", " route ", " passage "),
    "es": ("calle ", "c/", "avenida ", "avda", "av. ", "plaza ", "pza", "paseo ", "camino ", "carrera ", "ronda "),
    "ru": ("ул.", "улиц", "проспект", "пр-т", "просп.", "пер.", "переул", "шоссе", "наб.", "бульвар"),
    "zh": ("路", "街", "巷", "大道", "弄"),
}
TITLE_CUES = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "sir ", "madam ", "herr", "herrn", "frau", "mme", "mlle", "m.", "monsieur", "madame",
    "sr.", "sra.", "srta.", "señor", "señora", "don ", "doña ", "г-н", "г-жа", "господин", "госпожа", "先生", "女士", "小姐",
)
NAME_CUES = (
    "my name is", "my name's", "i am ", "i'm ", "i’m ", "this is ", "ask for ", "please tell ", "assigned to ", "signed off", "reviewed ", "contact person", "name:", "speak to ", "talk to ", "regards", "thanks", "cheers", "sincerely", "best wishes", "yours",
    "mein name ist", "ich bin ", "ich heiße", "zuständig ist", "grüße", "grüßen", "gruß", "ansprechpartner", "je m’appelle", "je m'appelle", "je suis ", "voir avec ", "cordialement", "bien à vous", "salutations", "mon nom est",
    "me llamo", "mi nombre es", "soy ", "pregunta por ", "saludos", "atentamente", "un saludo", "меня зовут", "с уважением", "обратитесь к", "спросите", "ответственн", "я — ", "我叫", "联系人", "姓名", "名字是", "请找",
)
RESERVED_DOMAIN = re.compile(r"(?:^|\.)(?:example\.(?:com|org|net)|test|invalid|example|localhost)$")

_LOCAL = r"[A-Za-z0-9_%+'’-]+(?:[ ]?(?:\.|\(dot\)|\[dot\])[ ]?[A-Za-z0-9_%+'’-]+)*"
_AT = r"(?:[ ]?[@＠][ ]?|[ ]?[(\[{]at[)\]}][ ]?)"
_DOT = r"(?:\.|[ ]?[(\[{]dot[)\]}][ ]?)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_EMAIL_TAIL = re.compile(_AT + rf"({_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}})", re.I)
_EMAIL_SPOKEN = re.compile(rf"[ ]at[ ]({_LABEL}(?:[ ]dot[ ]{_LABEL})*[ ]dot[ ][A-Za-z]{{2,}})(?![A-Za-z0-9])", re.I)
_EMAIL_HEAD = re.compile(r"(?:[A-Za-z0-9_%+'’-]|\.(?=[A-Za-z0-9_%+'’-])|[ ]?[(\[](?:dot)[)\]][ ]?|(?<=[A-Za-z0-9])[ ]dot[ ])+$", re.I)

_PHONE = re.compile(
    r"(?<![\w+.,/-])(?:"
    r"\+\d{1,3}(?:[ ./-]?\(\d{1,5}\))?(?:[ ./-]{0,3}\d{1,12}){1,7}"
    r"|00\d{2,3}(?:[ ./-]{1,3}\d{1,8}){2,6}"
    r"|0\d{2,5}[ ]?/[ ]?\d{2,4}(?:[ -]?\d{2,4}){1,4}"
    r"|0\d{2,4}[ -]\d{3,4}[ -]?\d{3,5}"
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}"
    r"|\d{3}([.-])\d{3}\1\d{4}"
    r"|1?\d{3}[ ]\d{3}[ ]\d{4}"
    r")(?![\d_/-]|[.,]\d)",
    re.A,
)
_NOT_PHONE = re.compile(r"(?:ticket|order|build|record|invoice|case|reference|ref|ref\.|version|seed|sha|no\.|nr\.|№|#|isbn|sku|account|Bestellung|Auftrag|commande|facture|pedido|заказ\w*|订单号?)[\s:#.]*$", re.I)
_PHONE_CUE = re.compile(r"(?:tel|tél|phone|call|mob|whatsapp|text|number|numéro|número|nummer|номер|тел|звон|电话|打|手机|fax|ruf|appel|llám)", re.I)

_ID_VALUE = re.compile(r"(?<![A-Za-z0-9_])(?:[A-Z]{1,3}[ -]?\d{6,10}|\d[\d. -]{5,16}\d(?:[ -]?[A-Z])?)(?![0-9_]|-[0-9])")
_ID_LINK = re.compile(
    r"^(?:[\s:#=№.]|n\.?º|n°|no\.?|nr\.?|number|num\.?|card|id|is|was|on file|es|lautet|ist|est|le|la|de|del|du|des|mein\w*|my|the|code|号码?|是|为|：|编号|number:|номер\w*|a|\w*nummer|,|[’'s])*$",
    re.I,
)
_ID_AFTER = re.compile(r"^[\s,]*(?:is|was|ist|est|es|—|-)?\s*(?:my|the|his|her|their|meine?|mon|ma|mi|мой)?\s*(?:passport|ssn|social security|tax id|id card|national id|driver|ausweis|passeport|dni|pasaporte)", re.I)

_W = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w’'-]*"
_STOP = frozenset(
    "the a an of in on at to for and or per with from by as is was are be this that these those after before about above under over near than then into out up until since once when while if so no not only each every both all some any more most half third first second last next "
    "der die das den dem des und oder von zu im in mit auf aus bei nach vor seit über unter ein eine einer einem einen ohne statt wegen trotz "
    "le la les un une de du des et ou en à au aux dans sur par pour avec sans sous dès "
    "el los las una unos unas y o del al con por para sin según desde hasta tokens rows minutes records seats times step line lines steps hours days words".split()
)
_EN_TYPE = r"(?:street|st|road|rd|lane|ln|avenue|ave|court|ct|drive|dr|terrace|square|sq|crescent|close|boulevard|blvd|place|pl|quay|row|way|gardens|highway)"
_EN_STREET = re.compile(rf"(?<![\w.,/$€£-])(\d{{1,5}}[A-Za-z]?)[ ]((?:[^\W\d_][\w’'-]*\.?[ ]){{1,3}}?)({_EN_TYPE})\b\.?", re.I)
_DE_STREET = re.compile(r"(?<!\w)(?:(?:[A-ZÄÖÜ][\wäöüß]*-){0,3}[A-ZÄÖÜ]?[\wäöüß-]*(?:straße|strasse|str\.|allee|weg|platz|gasse|ufer|damm))[ ]?\d{1,4}[ ]?[a-z]?(?!\w|[.,]\d)", re.I)
_FR_STREET = re.compile(r"(?<![\w.,])\d{1,4}(?:[ ]?(?:bis|ter|quater))?,?[ ](?:rue|impasse|allée|avenue|av\.|boulevard|bd|place|chemin|cours|quai|route|square|passage)[ ](?:(?:de|du|des|la|le|les|d’|d'|l’|l')[ ]?)*[^\W\d_][\w’'-]*", re.I)
_ES_STREET = re.compile(r"(?<!\w)(?:calle|c/|avenida|avda\.?|av\.|plaza|pza\.?|paseo|camino|carrera|ronda)[ ]?(?:(?:de|del|la|los|las)[ ])*[^\W\d_][\w’'-]*(?:[ ][^\W\d_][\w’'-]*){0,3},?[ ](?:n\.?º[ ]?|núm\.[ ]?)?\d{1,4}(?!\w|[.,]\d)", re.I)
_RU_STREET = re.compile(r"(?<!\w)(?:ул\.|улиц[аеуы]|проспект\w?|просп\.|пр-т|пер\.|переул\w+|шоссе|наб\.|бульвар\w?)[ ]?[^\W\d_][\w-]*(?:[ ][^\W\d_][\w-]*)?,?[ ](?:д\.|дом)?[ ]?\d{1,4}(?!\d)", re.I)
_ZH_STREET = re.compile(r"[一-鿿]{1,6}?(?:路|街|巷|大道|弄)[ ]?\d{1,5}[ ]?号(?:[ ]?\d{1,5}[ ]?(?:室|楼|单元|号))*")
_STREETS = {"en": _EN_STREET, "de": _DE_STREET, "fr": _FR_STREET, "es": _ES_STREET, "ru": _RU_STREET, "zh": _ZH_STREET}
_WEAK_TYPES = frozenset(("way", "row", "close", "drive", "place", "st", "dr", "ct", "pl", "rd", "ln", "sq"))
_DIGIT = re.compile(r"\d")
_LONG_NUMBER = re.compile(r"[\d(+][\d ().+/-]{6,}\d")
_BOX = re.compile(r"(?<!\w)(?:p\.?[ ]?o\.?[ ]box|post office box|postfach|boîte postale|bp|apartado(?: de correos| postal)?|apdo\.?(?: de correos)?|а/я|абонентский ящик|邮政信箱|信箱)[ ]?(?:n\.?º|nr\.|no\.|№)?[ ]?\d{2,8}", re.I)
_ADDRESS_TAIL = re.compile(
    rf"(?:[ ]?,[ ]?(?:(?i:apt|unit|flat|suite|кв|д|bajo|bis)\.?[ ]?(?:[A-Z]|\d{{1,4}})?|\d\.?º[ ]?[A-Z]?|(?:D-|F-|E-)?\d{{4,6}}(?:[ ]{_W}(?:[ ]{_W}){{0,2}})?|{_W}(?:[ ]{_W}){{0,2}}(?:[ ]\d{{4,6}})?|кв\.[ ]?\d+|bajo)(?![\w@]))*"
    rf"(?:[ ]in[ ]{_W}(?:[ ]{_W})?)?"
)
_ADDRESS_HEAD = re.compile(r"(?:flat|apt|unit|suite)\.?[ ]\w{1,4},[ ]?$", re.I)

_CAP = re.compile(r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w’']*(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ]?[\w’']+)*")
_TOKEN = re.compile(r"[^\W\d_][\w’']*(?:-[^\W\d_][\w’']*)*")
#: Words that stand with a capital but are no part of a personal name. Fixed values.
_NO_NAME = frozenset(
    "the a an i we you he she it they this that there here what which who when where why how if in on at by for from with of to and or but yes no not as is are was were be can could would should do does did please thanks regards dear hello hi "
    "team support service console ledger index archive report board desk group department office project sales billing admin everyone all monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december "
    "english german french spanish russian chinese ping call write reply send contact mail tel oddly apparently since once most every during after before according far "
    "der die das ein eine ich wir sie es ist und mit von zu im le la les un une je nous vous il elle ce cette el los las una yo nosotros que de du des del al en por para con mi tu su como cómo si lo se".split()
)
_PLACE_HEAD = frozenset("port lake mount saint north south east west upper lower old new fort cape bay falls street road lane avenue court baja".split())
_PRODUCT_TAIL = frozenset("console ledger index lane board suite cloud archive report team project platform dashboard".split())
_TITLED = re.compile(
    r"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Srta|Herrn?|Frau|Mme|Mlle|MM?|Miss|Sir|Madam|Monsieur|Madame|Señora?|Don|Doña|Господин|Госпожа|господин|госпожа|г-н|г-жа)\.?|(?:MR|MRS|MS|DR|PROF|SR|SRA|HERR|FRAU|MME)\.?)[ ](?:(?:Dr|Prof)\.[ ])?$"
)
_INITIAL = re.compile(r"(?<![\w.])[A-ZÀ-ÖØ-ÞА-ЯЁ]\.(?:[ ]?[A-ZА-ЯЁ]\.)*[ ]?$")
_SIGN_OFF = re.compile(
    r"(?:^|[\s.!?…)])(?:(?:many |best |kind |warm )?regards|(?:many )?thanks(?: again| a lot)?|thank you|cheers|sincerely|yours(?: truly| sincerely| faithfully)?|best wishes|best|"
    r"(?:viele|beste|liebe|schöne|freundliche)[ ]grüße|mit freundlichen grüßen|(?:schönen|lieben|besten)? ?gruß|danke|cordialement|bien à vous|(?:sincères |meilleures )?salutations|merci|"
    r"(?:un )?saludos?|atentamente|gracias|с уважением|спасибо|всего доброго|此致|敬上|谢谢)[ ]?[,!.，。—-]?\s*[-—–]?\s*$",
    re.I,
)
_FRAME_BEFORE = re.compile(
    r"(?:my name is|my name[’']s|\bname ?:|i[’']m|\bi am|this is|ask for|please tell|tell|assigned to|speak to|talk to|contact person:?|mein name ist|ich bin|ich heiße|zuständig ist|ansprechpartner(?:in)?(?: ist)?:?|je m[’']appelle|je suis|voir avec|mon nom est|"
    r"me llamo|mi nombre es|\bsoy|pregunta por|меня зовут|обратитесь к|спросите|ответственн\w+(?: —|:)?|contact(?: is)?:?|kontakt:?|contacto:?)[ ]$",
    re.I,
)
_FRAME_AFTER = re.compile(r"[ ](?:signed off|reviewed the|approved|from (?:accounts|support|sales|billing|finance|the)|and i own|hat das|a validé|lo revisó|owns the|about it|at the desk|on this|проверил|подписал|согласовал)", re.I)
_COMMA_PAIR = re.compile(r"([A-ZÀ-ÞА-ЯЁ][\w’']*(?:-[\w’']+)*),[ ]([A-ZÀ-ÞА-ЯЁ][\w’']*(?:-[\w’']+)*)(?=[.;!\n]|$)")
_LOWER_PAIR = re.compile(r"([^\W\d_]+(?:-[^\W\d_]+)*)[ ]([^\W\d_]+(?:-[^\W\d_]+)*)(?=[ ]and i[ ]|[ ]from[ ]|,[ ]i[ ])")
#: Words after "i am" that begin no name. Fixed values.
_NO_PERSON = frozenset("very so really not also still just quite too happy glad sure new sorry aware able about going trying looking using working here back done ready afraid certain unable interested only always never already pretty totally completely fairly rather both now currently".split())
#: Chinese family names of two characters, and the usual ones of one. Fixed values.
_ZH_DOUBLE = "慕容|欧阳|司马|诸葛|上官|司徒|东方|皇甫|尉迟|公孙|令狐|宇文|长孙|夏侯|端木|轩辕|南宫|百里"
_ZH_SINGLE = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文司欧"
_ZH_NAME = re.compile(
    rf"(?:(?:联系人|姓名|署名)[：:][ ]?((?:{_ZH_DOUBLE})[一-鿿]{{1,2}}|[{_ZH_SINGLE}][一-鿿]{{2}}|[一-鿿]{{2,3}})"
    rf"|(?:我叫|我的名字是|名字是|请找)(?:([一-鿿]{{2,4}})(?=$|[\s。，、！？；：,.!?;A-Za-z0-9])|((?:{_ZH_DOUBLE})[一-鿿]{{1,2}}|(?<=叫)[{_ZH_SINGLE}][一-鿿]{{2}})))"
)
_ZH_TITLED = re.compile(r"([一-鿿]{1,3})(?:先生|女士|小姐|老师)")
_ZH_WORDS = re.compile(r"[的了是在们个不这那些什么人工客服负责同事对方]")


@cache
def _anchors(names: tuple[str, ...]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    groups = {"at": AT_CUES, "id": ID_CUES, "box": BOX_CUES, "title": TITLE_CUES, "cue": NAME_CUES} | STREET_CUES
    kinds: dict[str, set[str]] = {}
    for kind, words in groups.items():
        for w in words:
            kinds.setdefault(w, set()).add(kind)
    for w in names:
        kinds.setdefault(w, set()).add("listed")
    for w, k in kinds.items():
        automaton.add_word(w, (len(w), tuple(sorted(k))))
    automaton.make_automaton()
    return automaton


class Finder:
    """Finds items in texts. given, family: listed personal names, in any case; they may be incomplete."""

    def __init__(self, given: frozenset[str] = frozenset(), family: frozenset[str] = frozenset()) -> None:
        self.given = frozenset(x.lower() for x in given if x)
        self.family = frozenset(x.lower() for x in family if x)
        self.automaton = _anchors(tuple(sorted(self.given | self.family)))

    def items(self, text: str) -> list[Item]:
        """The items of one text, in order, none overlapping another."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        hits: dict[str, list[tuple[int, int]]] = {}
        for end, (n, kinds) in self.automaton.iter(low):
            for kind in kinds:
                hits.setdefault(kind, []).append((end - n + 1, end + 1))
        found: list[Item] = []
        if "at" in hits:
            found += self._emails(text, hits["at"])
        if _DIGIT.search(text):
            if "id" in hits:
                found += self._ids(text, hits["id"])
            if "box" in hits:
                found += [Item(m.start(), m.end(), "address") for m in _BOX.finditer(text)]
            for tongue in STREET_CUES.keys() & hits.keys():
                found += self._streets(text, tongue, hits[tongue])
            if _LONG_NUMBER.search(text):
                found += self._phones(text, found)
        if hits.keys() & {"title", "cue", "listed"}:
            found += self._names(text, low, hits)
        if len(found) < 2:
            return found
        kept: list[Item] = []
        for item in sorted(found, key=lambda x: (RANK[x.kind], x.start, -x.end)):
            if not any(item.start < k.end and k.start < item.end for k in kept):
                kept.append(item)
        return sorted(kept)

    def kinds(self, text: str) -> list[str]:
        """The kinds that occur, each once."""
        return sorted({x.kind for x in self.items(text)})

    def redacted(self, text: str, items: list[Item] | None = None) -> str:
        """The text with a typed placeholder for each item and all other words as they are."""
        parts, at = [], 0
        for x in self.items(text) if items is None else items:
            parts += [text[at : x.start], PLACEHOLDERS[x.kind]]
            at = x.end
        return "".join(parts) + text[at:]

    @staticmethod
    def _emails(text: str, hits: list[tuple[int, int]]) -> Iterator[Item]:
        for s, e in hits:
            at = s - 1 if s and text[s - 1] == " " and text[s] != " " else s
            tail = _EMAIL_TAIL.match(text, at) or _EMAIL_TAIL.match(text, s)
            if not tail:
                tail = _EMAIL_SPOKEN.match(text, s)
            if not tail:
                continue
            head = _EMAIL_HEAD.search(text[max(0, tail.start() - 80) : tail.start()])
            local = head.group().strip(" .") if head else ""
            if not local:
                continue
            domain = re.sub(r"[ ]?[(\[{]dot[)\]}][ ]?|[ ]dot[ ]", ".", tail.group(1).lower())
            if RESERVED_DOMAIN.search(domain):
                continue
            if text[tail.end() : tail.end() + 1] == ":" and re.match(r":[\w~./-]*/", text[tail.end() : tail.end() + 80]):
                continue  # a remote path of a repository
            yield Item(tail.start() - len(head.group().lstrip(" .")), tail.end(), "email")

    @staticmethod
    def _ids(text: str, hits: list[tuple[int, int]]) -> Iterator[Item]:
        for s, e in hits:
            if s and text[s - 1].isalpha() and text[s].isascii() and text[s - 1].isascii():
                continue
            near = text[e : e + 70]
            m = _ID_VALUE.search(near)
            if m and sum(map(str.isdigit, m.group())) >= 6:
                between = re.sub(r"^[\wäöüß’'-]*", "", near[: m.start()], count=1) if near[:1].isalpha() else near[: m.start()]
                if _ID_LINK.match(between) or _ID_LINK.match(near[: m.start()]):
                    yield Item(e + m.start(), e + m.end(), "id_number")
                    continue
            before = text[max(0, s - 40) : s]
            last = None
            for last in _ID_VALUE.finditer(before):
                pass
            if last and sum(map(str.isdigit, last.group())) >= 6 and _ID_AFTER.match(before[last.end() :] + text[s:e]):
                yield Item(s - len(before) + last.start(), s - len(before) + last.end(), "id_number")

    @staticmethod
    def _streets(text: str, tongue: str, hits: list[tuple[int, int]]) -> Iterator[Item]:
        done = 0
        for s, e in hits:
            if s < done:
                continue
            low, high = max(done, s - 60), e + 80
            near = text[low:high]
            if not _DIGIT.search(near):
                continue
            for m in _STREETS[tongue].finditer(near):
                a, b = low + m.start(), low + m.end()
                if not a <= s < b or a < done:
                    continue
                if tongue == "en":
                    words, kind = m.group(2).split(), m.group(3)
                    if any(w.lower().strip(".") in _STOP for w in words):
                        continue
                    if kind in _WEAK_TYPES and all(w.islower() for w in words):
                        continue
                if tongue == "de" and not text[a].isupper():
                    continue
                tail = _ADDRESS_TAIL.match(text, b) if tongue != "zh" else None
                head = _ADDRESS_HEAD.search(text[max(done, a - 12) : a])
                done = tail.end() if tail else b
                yield Item(a - len(head.group()) if head else a, done, "address")

    @staticmethod
    def _phones(text: str, taken: list[Item]) -> Iterator[Item]:
        for m in _PHONE.finditer(text):
            s, e = m.span()
            if any(s < t.end and t.start < e for t in taken):
                continue
            number = m.group()
            digits = re.sub(r"\D", "", number)
            if not 8 <= len(digits) <= 15:
                continue
            if re.fullmatch(r"1?[2-9]\d{2}555\d{4}", digits) and number[0] != "0":
                continue
            before = text[max(0, s - 24) : s]
            if _NOT_PHONE.search(before):
                continue
            if re.fullmatch(r"\d{3} \d{3} \d{4}", number) and not _PHONE_CUE.search(before):
                continue
            yield Item(s, e, "phone")

    def _name_word(self, word: str) -> bool:
        return word.lower() not in _NO_NAME

    def _listed(self, word: str) -> bool:
        w = word.lower()
        return w in self.given or w in self.family

    def _full(self, text: str, s: int, e: int) -> tuple[int, int] | None:
        """A full name around the listed word at s:e: given and family name side by side, in any order and case."""
        word = text[s:e]
        w = word.lower()
        lower = word.islower()
        after = re.compile(r",?[ ]([^\W\d_][\w’']*(?:-[^\W\d_][\w’']*)*)").match(text, e)
        if after:
            other, gap = after.group(1), text[e : after.start(1)]
            o = other.lower()
            pair = (w in self.given and o in self.family) or (w in self.family and o in self.given)
            tail = re.match(r"[ ]([^\W\d_][\w-]*)", text[after.end() : after.end() + 20])
            product = tail and tail.group(1).lower() in _PRODUCT_TAIL and tail.group(1)[:1].isupper()
            if pair and not product and (gap == " " or w in self.family) and not (lower and gap != " "):
                if not lower or not self._ordinary(w) or not self._ordinary(o):
                    return s, after.end()
            if gap == " " and not lower and other[:1].isupper() and self._name_word(other) and o not in _PRODUCT_TAIL and o not in _PLACE_HEAD:
                before = text[max(0, s - 30) : s]
                if w in self.given and not self._ordinary(w) and not re.search(r"(?:team behind|the|plan called) $", before) and not word.isupper():
                    return s, after.end()
        if w in self.family and not lower:
            before = re.search(r"([^\W\d_][\w’']*(?:-[^\W\d_][\w’']*)*)[ ]$", text[max(0, s - 30) : s])
            if before and before.group(1)[:1].isupper() and not before.group(1).isupper() and not self._ordinary(w):
                o = before.group(1).lower()
                if self._name_word(before.group(1)) and o not in _PLACE_HEAD and o not in self.family and not _TITLED.search(text[max(0, s - 30) : s]) and o not in _TITLE_WORDS:
                    return s - len(before.group()), e
        return None

    @staticmethod
    def _ordinary(word: str) -> bool:
        """Listed names that are ordinary words as well; alone they prove nothing."""
        return word in _ORDINARY_WORDS

    def _names(self, text: str, low: str, hits: dict[str, list[tuple[int, int]]]) -> Iterator[Item]:
        for s, e in hits.get("listed", ()):
            if (s and (low[s - 1].isalnum() or low[s - 1] in "-_.@")) or (e < len(low) and (low[e].isalnum() or low[e] in "-_@")):
                continue
            if pair := self._full(text, s, e):
                yield Item(*pair, "name")
                continue
            before = text[max(0, s - 32) : s]
            if _INITIAL.search(before) and text[s].isupper() and low[s:e] in self.family:
                yield Item(s - len(_INITIAL.search(before).group()), e, "name")
        for s, e in hits.get("title", ()):
            if s and (low[s - 1].isalnum() or low[s - 1] in "-_.@"):
                continue
            yield from self._titled(text, s, e)
        if "cue" in hits:
            yield from self._framed(text, low, hits["cue"])

    def _titled(self, text: str, s: int, e: int) -> Iterator[Item]:
        if text[s] > "⺀":
            for m in _ZH_TITLED.finditer(text[max(0, s - 3) : e]):
                if not _ZH_WORDS.search(m.group(1)):
                    yield Item(max(0, s - 3) + m.start(), max(0, s - 3) + m.end(), "name")
            return
        m = re.compile(r"\.?[ ](?:(?:Dr|Prof)\.?[ ])?").match(text, e - (text[e - 1] in ". "))
        if not m or not text[s].isalpha() or not _TITLED.search(text[:m.end()][-40:]):
            return
        t = _CAP.match(text, m.end())
        if t and len(t.group()) > 1 and self._name_word(t.group()):
            if text[s:e].lower() in ("m.", "don ", "sir ") and t.group().lower() in _NO_NAME:
                return
            more = re.compile(r"[ ](" + _CAP.pattern + ")").match(text, t.end())
            end = more.end() if more and self._listed(more.group(1)) else t.end()
            yield Item(t.start(), end, "name")

    def _run(self, text: str, at: int, most: int = 3) -> list[re.Match[str]]:
        """Words with a capital, or listed names in any case, that follow one another from at."""
        words: list[re.Match[str]] = []
        while len(words) < most:
            m = _TOKEN.match(text, at)
            if not m or not self._name_word(m.group()) or not (m.group()[0].isupper() or self._listed(m.group())):
                break
            words.append(m)
            at = m.end()
            if text[at : at + 2] == ", " and len(words) == 1 and m.group().lower() in self.family:
                at += 2
            elif text[at : at + 1] == " ":
                at += 1
            else:
                break
        return words

    def _framed(self, text: str, low: str, cues: list[tuple[int, int]]) -> Iterator[Item]:
        for s, e in cues:
            if text[s] > "⺀":
                m = _ZH_NAME.match(text, s)
                if m and not _ZH_WORDS.search(m.group(m.lastindex)):
                    yield Item(m.start(m.lastindex), m.end(m.lastindex), "name")
                continue
            if s and low[s - 1].isalnum():
                continue
            word = low[s:e].strip()
            if word in ("signed off", "reviewed"):
                if not text[s:e].islower():
                    continue
                before = re.search(r"((?:[A-ZÀ-ÞА-ЯЁ][\w’']*(?:-[\w’']+)*|[A-Z]\.)[ ]){1,3}$", text[max(0, s - 60) : s])
                if before:
                    words = before.group().split()
                    while words and not self._name_word(words[0]):
                        words.pop(0)
                    if len(words) >= 2 and not (len(words) == 2 and _TITLED.search(words[0] + " ")):
                        start = s - len(" ".join(words)) - 1
                        yield Item(start, s - 1, "name")
                continue
            sign = _SIGN_OFF.search(text[max(0, s - 12) : e + 12].split("\n")[0] if False else text[max(0, s - 12) : e])
            rest = re.compile(r"(?:[ ]again|[ ]a lot|[ ]wishes|[ ]truly)?[ ]?[,!.，]?[ ]*(?:\r?\n[ ]*)?[-—–]?[ ]?").match(text, e)
            if sign and rest and (rest.group().strip() or "\n" in rest.group()):
                words = self._run(text, rest.end())
                if words:
                    end_line = re.match(r"[ \t]*(?:$|\r?\n)", text[words[-1].end() :])
                    first = words[0].group()
                    if self._listed(first) or end_line or (len(words) > 1 and self._listed(words[1].group())) or "-" in first:
                        yield Item(words[0].start(), words[min(len(words), 2) - 1].end() if not end_line else words[-1].end(), "name")
                continue
            at = e + (text[e : e + 1] == " ") if text[e - 1] != " " else e
            at += 1 if text[at : at + 1] in ":：" and text[at + 1 : at + 2] else 0
            at += text[at : at + 1] == " "
            if word == "assigned to" and (pair := _COMMA_PAIR.match(text, at)) and self._name_word(pair.group(1)) and self._name_word(pair.group(2)):
                yield Item(pair.start(), pair.end(), "name")
                continue
            if word == "i am" and (pair := _LOWER_PAIR.match(text, at)) and not (set(pair.group(1, 2)) & _NO_PERSON) and self._name_word(pair.group(1)) and self._name_word(pair.group(2)):
                yield Item(pair.start(), pair.end(2), "name")
                continue
            if not _FRAME_BEFORE.search(low[max(0, at - 40) : at]):
                continue
            words = self._run(text, at)
            if not words:
                continue
            if len(words) == 1:
                continue
            a, b = words[0].group(), words[1].group()
            strong = re.search(r"(?:name|heiße|appelle|llamo|nombre|зовут|nom est)", low[max(0, at - 16) : at])
            listed = self._listed(a) or self._listed(b)
            known = _FRAME_AFTER.match(text, words[1].end()) or re.search(r"(?:ask for|please tell|pregunta por|voir avec|zuständig ist|assigned to)[ ]$", low[max(0, at - 16) : at])
            if b.lower() in _PRODUCT_TAIL or a.lower() in _PLACE_HEAD:
                continue
            if strong or listed or known:
                yield Item(words[0].start(), words[1].end(), "name")


#: English words among listed names; a common-noun reading is as likely as a name. Fixed values.
_ORDINARY_WORDS = frozenset("mark amber baker summer sterling page archer grace ledger may reed rivers marsh stone will vale field rose sorrel hunter faith hope joy dawn ivy heather forest brook lake hill wood park young king bishop carter cook miller mason potter porter taylor fisher gardener smith day winter frost snow".split())
_TITLE_WORDS = frozenset("mr mrs ms miss dr prof sir madam herr herrn frau mme mlle monsieur madame sr sra srta señor señora don doña".split())


def _scan(given: frozenset[str], family: frozenset[str], detail: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(given, family)
        for b in batches:
            rows, second, third = [], [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                items = finder.items(text)
                if not items:
                    continue
                if detail:
                    rows.append(i)
                    second.append(finder.redacted(text, items))
                    third.append(len(items))
                else:
                    kinds = sorted({x.kind for x in items})
                    rows += [i] * len(kinds)
                    second += kinds
            keys = b.select(["table_name", "line_no", "turn"]).take(pa.array(rows, pa.int64()))
            extra = [pa.array(second, pa.string()), pa.array(third, pa.int32())] if detail else [pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays([*keys.columns, *extra], ["table_name", "line_no", "turn", *(["redacted", "items"] if detail else ["kind"])])

    return run


def listed_names(names: DataFrame, most: int = 200_000) -> tuple[frozenset[str], frozenset[str]]:
    """(given, family) of a name list. The list is a reference table of bounded size; a longer one is an error."""
    rows = names.select("person_name", "kind").where("person_name is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the name list has more than {most} names")
    return frozenset(r.person_name for r in rows if r.kind == "given"), frozenset(r.person_name for r in rows if r.kind == "family")


def kinds_found(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(table_name, line_no, turn, kind): one row for each text and each kind it holds."""
    some = texts.select("table_name", "line_no", "turn", "text").where("text is not null")
    return some.mapInArrow(_scan(*listed_names(names), False), "table_name string, line_no bigint, turn bigint, kind string")


def redacted(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(table_name, line_no, turn, redacted, items) of every text that holds an item."""
    some = texts.select("table_name", "line_no", "turn", "text").where("text is not null")
    return some.mapInArrow(_scan(*listed_names(names), True), "table_name string, line_no bigint, turn bigint, redacted string, items int")
