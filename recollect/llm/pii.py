"""Personal information inside free text.

Method: offset-preserving deobfuscation.  Transducers rewrite a text step by step: wide
and mathematical letters, look-alikes from other scripts and zero-width characters become
plain letters; spelled digits become digits; "(at)" and "dot" disguises become marks.  Each
step keeps, for every output character, the source span it came from.  Identifiers are
detected in the normalised text and their spans are mapped back, so that placeholders
replace exactly the source characters and all else stays as it was.

Detectors: e-mail addresses, phone numbers, identity numbers (national, tax, passport),
street addresses and names of persons.  Names come from contexts that introduce a person,
from titles, and from the family names of known persons (``NameParts``).

All of it is a narrow pass over Arrow batches of (key, text); the known persons are a
bounded dimension, checked against ``MAX_PERSONS`` when they are gathered.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.arrow import task_mapper

KINDS = ("email", "phone", "id_number", "address", "name")
#: Known persons that are sent to every task; more than these is an error, not a cut.
MAX_PERSONS = 200_000


class Span(NamedTuple):
    start: int
    end: int
    kind: str


# --- transducers ------------------------------------------------------------------------

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(
    zip(
        "АВСЕНІЈКМОРЅТХУаеорсухіјѕԁɡһ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν" + "ı",
        "ABCEHIJKMOPSTXYaeopcyxijsdgh" + "ABEZHIKMNOPTYXoav" + "i",
    )
)
#: Digits spelled out.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
CJK_DIGITS = dict(zip("零〇一二三四五六七八九幺", "001234567891"))

_spelled = re.compile(r"\b(?:(?:double|triple)[\s-]+)?(?:%s)(?:[\s,.-]+(?:(?:double|triple)[\s-]+)?(?:%s|\d+)){4,}\b" % (("|".join(DIGIT_WORDS),) * 2), re.I)
_spelled_word = re.compile(r"(?:(double|triple)[\s-]+)?(%s)|\d" % "|".join(DIGIT_WORDS), re.I)
_cjk_digits = re.compile(r"[零〇一二三四五六七八九幺]{7,}")
_at = re.compile(r"(?<=[\w])\s*(?:\(at\)|\[at\]|\{at\}|<at>|＠|\s@\s?|@\s|\s+at\s+(?=[\w-]+(?:\s+dot\s+|\s*[\[({]dot[\])}]\s*)))\s*", re.I)
_dot = re.compile(r"(?<=\w)\s*(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\s+dot\s+)\s*(?=\w)", re.I)
_hints = re.compile(r"dot|\bat\b|\(at|\[at|\{at|\s@|@\s|zero|one|two|three|four|five|six|seven|eight|nine|[^\x00-\x7f]", re.I)


#: Characters that may be a disguise; CJK digits are one in long runs only.
_odd = re.compile(r"[^\x00-\x7f一-鿿，。：；？！、（）《》“”…–—]|[零〇一二三四五六七八九幺]{7}")


class Mapped:
    """A text with the source span of each of its characters."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return self.starts[start], self.ends[end - 1]

    def rewrite(self, pieces: Iterable[tuple[int, int, str]]) -> Mapped:
        """Replace [start, end) by a string, for pieces in ascending order."""
        out, starts, ends, at = [], [], [], 0
        own_s = self.starts or range(len(self.text))
        own_e = self.ends or range(1, len(self.text) + 1)
        for a, b, new in pieces:
            out.append(self.text[at:a])
            starts += own_s[at:a]
            ends += own_e[at:a]
            out.append(new)
            starts += [own_s[a]] * len(new)
            ends += [own_e[b - 1]] * len(new)
            at = b
        out.append(self.text[at:])
        starts += own_s[at:]
        ends += own_e[at:]
        return Mapped("".join(out), starts, ends)


def _plain_letters(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _odd.finditer(text):
        i, c = m.start(), m[0]
        if len(c) > 1:
            continue
        if unicodedata.category(c) == "Cf":
            out.append((i, i + 1, ""))
        elif c in LOOKALIKES:
            near = text[max(0, i - 1) : i] + text[i + 1 : i + 2]
            if any(x.isascii() and x.isalnum() or x in LOOKALIKES or x in "@." for x in near):
                out.append((i, i + 1, LOOKALIKES[c]))
        else:
            plain = unicodedata.normalize("NFKC", c)
            if plain != c and plain:
                out.append((i, i + 1, plain))
    return out


def _digits_of(words: str) -> str:
    out = []
    for m in _spelled_word.finditer(words):
        digit = DIGIT_WORDS[m[2].lower()] if m[2] else m[0]
        out.append(digit * {"double": 2, "triple": 3}.get((m[1] or "").lower(), 1))
    return "".join(out)


def normalise(text: str) -> Mapped:
    """The text without disguises, with the source spans of its characters."""
    mapped = Mapped(text)
    if not _hints.search(text):
        return mapped
    if not text.isascii():
        if pieces := _plain_letters(text):
            mapped = mapped.rewrite(pieces)
        if pieces := [(*m.span(), "".join(CJK_DIGITS[c] for c in m[0])) for m in _cjk_digits.finditer(mapped.text)]:
            mapped = mapped.rewrite(pieces)
    if pieces := [(*m.span(), _digits_of(m[0])) for m in _spelled.finditer(mapped.text)]:
        mapped = mapped.rewrite(pieces)
    if pieces := [(*m.span(), "@") for m in _at.finditer(mapped.text)]:
        mapped = mapped.rewrite(pieces)
    if pieces := [(*m.span(), ".") for m in _dot.finditer(mapped.text)]:
        mapped = mapped.rewrite(pieces)
    return mapped


# --- detectors --------------------------------------------------------------------------

_email = re.compile(r"(?<![\w.%+/:@-])(?:mailto:)?([A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?)@((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})(?![\w@]|\.\w|:[\w/~])", re.I)
_mailto = re.compile(r"mailto:([A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", re.I)

_phone = re.compile(
    r"(?<![\w.+/-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(0\) ?)?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}"  # international
    r"|\(\d{2,4}\) ?\d{3,4}[ .-]?\d{3,4}"  # area code in brackets
    r"|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}"  # 3-3-4
    r"|\d{3}-\d{4}(?= ?(?:ext|x)\b)"  # local number with an extension
    r"|0\d{2,3}-\d{7,8}"  # trunk code
    r")(?: ?(?:ext\.?|x) ?\d{1,5})?(?![\w-]|\.\d)",
    re.I,
)
_phone_context = re.compile(r"(?:\b(?:tel|phone|mobile|cell|fax|call|text|sms|whatsapp|on-call line)\b(?: me)?(?: at| on)?|电话|手机|致电|拨打|联系方式)\W{0,4}(\+?\d(?:[ .-]?\d){6,14}|\d{3}-\d{4})(?![\w-])", re.I)

_ids = re.compile(
    r"(?<![\w-])(?:"
    r"\d{3}-\d{2}-\d{4}|\d{3} \d{2} \d{4}"  # social security and tax numbers, 3-2-4
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"  # national insurance
    r"|[A-Z]{2}\d{7}"  # passport
    r"|\d{6}(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dX]"  # resident identity, with its birth date
    r")(?![\w-])",
    re.I,
)
_id_context = re.compile(r"(?:passport|national id|identity card|id no|tax (?:id|no|number)|social security|ssn|身份证|护照|税号|纳税人识别号|证件)[^\n.。;；]{0,24}?(?<![A-Za-z0-9-])((?=[A-Z0-9 -]*\d{4})[A-Z0-9](?:[ -]?[A-Z0-9]){5,19})(?![A-Za-z0-9-])", re.I)

_STREET = "street|st|road|rd|lane|ln|avenue|ave|boulevard|blvd|drive|dr|way|crescent|cres|court|ct|place|pl|square|terrace|close|row|hill|gardens"
_address = re.compile(
    r"(?<![\w.-])(?:(?:flat|apt|unit|suite)\.? ?\d+\w?, )?\d{1,5}[A-Z]? (?:[A-Z][\w'-]+ ){1,3}(?:%s)\b\.?(?:, (?:apt|flat|unit|suite)\.? ?\d*\w?)?"
    r"(?:, [A-Z][\w-]+(?: [A-Z][\w-]+)?(?: \d{4,6})?(?![\w-])|(?=, (?:apt|flat|unit|suite))|(?= in [A-Z]))" % _STREET,
    re.I,
)
_address_de = re.compile(r"(?<![\w-])[A-Z][\w-]*(?:weg|straße|strasse|str\.|gasse|allee|platz|ufer|damm)\s\d{1,4}[a-z]?,? \d{4,5} [A-Z][\w-]+", re.I)
_address_zh = re.compile(r"(?:[一-鿿]{2,8}(?:省|市|区|县|镇|乡))?[一-鿿]{1,8}(?:路|街|巷|道|弄|胡同|大街)\d{1,5}号(?:[\d一-鿿]{0,4}?(?:单元|栋|幢|楼|室|层)){0,4}(?:\d{1,5}室)?")
_no_address = re.compile(r"\b(?:jobs|tiles|tests|runs|items|rows)\b", re.I)

#: Family names of two characters, and common ones of one.
CJK_DOUBLE = "欧阳 司徒 慕容 端木 钟离 闻人 上官 诸葛 司马 皇甫 尉迟 公孙 东方 令狐 宇文 长孙 夏侯 南宫 西门 独孤 轩辕 澹台 濮阳 淳于 单于 太史 申屠 公羊 赫连 拓跋 百里 呼延".split()
CJK_SINGLE = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_AFTER_ZH = r"(?=[，。、；：,.;:\s）)]|$|一起|说|负责|先生|女士|老师|电话|邮箱|来|已|会|的)"
_name_zh = re.compile(r"(?:%s)[一-鿿]{1,2}?%s" % ("|".join(CJK_DOUBLE), _AFTER_ZH))
_name_zh_context = re.compile(r"(?:请联系|联系人[:：]?|我叫|我是|昨天和|今天和|刚和|负责人[:：]|姓名[:：]|收件人[:：]|转告)((?:%s|[%s])[一-鿿]{1,2}?)%s" % ("|".join(CJK_DOUBLE), CJK_SINGLE, _AFTER_ZH))

_UP = r"[A-ZÀ-ÖØ-Þ]"
_PART = r"(?:%s[\w'’-]+)" % _UP
_INITIAL = r"(?:%s\.)" % _UP
_TITLE = r"(?:Dr|Mr|Mrs|Ms|Miss|Mx|Prof|Professor|Sir|Madam|Herr|Frau)\.?"
_FULL = r"(?:(?:%s )?(?:%s|%s)(?: %s| %s)? %s(?!\w)|%s, %s(?!\w))" % (_TITLE, _PART, _INITIAL, _INITIAL, _PART, _PART, _PART, _PART)
_LETTERS = r"(?!(?:and|or|from|the)\b)[^\W\d_][^\W\d_'’.-]*"
_ANYCASE = r"%s(?: %s){1,2}|%s, %s" % ((_LETTERS,) * 4)
_name_title = re.compile(r"(?<![\w.])(?:Dr|Mr|Mrs|Ms|Mx|Prof)\. ?(?:%s )?%s(?:[ ]%s)?" % (_INITIAL, _PART, _PART))
#: Contexts that introduce a person, in any case of letters.
_name_context = re.compile(
    r"(?:\bmy name is |\bi am called |\bname=|\| owner \| |\bsigned(?:-off)?(?:-by)?: ?|\bforwarded message from |\bhi, this is )(%s)(?=[\s,;.()|<]|$)" % _ANYCASE, re.I
)
#: Words that may introduce a person, and that a person does; the name must look like one.
BEFORE_NAME = (
    "contact: ", "i spoke with ", "spoke to ", "talked to ", "talked with ", "met ", "meeting with ", "pairing with ", "paired with ", "ask ", "asked ", "told ", "according to ", "thanks to ", "assigned to ", "reported by ",
    "reviewed by ", "approved by ", "written by ", "requested by ", "escalated to ", "handed over to ", "reach out to ", "on behalf of ", "interview with ", "introduced to ", "regards, ", "sincerely, ", "hello ", "dear ",
)
AFTER_NAME = (
    "took over", "wrote the", "asked us", "joined", "left us", "approved", "signed", "called", "said", "told us", "reported that", "replied", "suggested", "agreed", "confirmed that", "is on leave", "is out of office", "will join", "reviewed the",
)
_name_context_full = re.compile(r"\b(?:%s)(%s)" % ("|".join(map(re.escape, (*BEFORE_NAME, *(x[0].upper() + x[1:] for x in BEFORE_NAME)))), _FULL))
_name_subject = re.compile(r"(?:^|(?<=[.!?\n] )|(?<=\n))(%s)(?= (?:%s)\b|, (?:\d{1,5}|flat|apt) [A-Z])" % (_FULL, "|".join(AFTER_NAME)), re.M)
_NO_NAME = set("the a an this that these those we our it its they labs team project vault".split())


class NameParts:
    """Family and given names of known persons, and all hints, in one automaton."""

    def __init__(self, persons: Iterable[str]):
        import ahocorasick

        self.given: set[str] = set()
        self.family: set[str] = set()
        for person in persons:
            words = [w for w in re.split(r"\s+", (person or "").strip()) if w]
            if len(words) >= 2 and all(re.fullmatch(_PART, w) for w in (words[0], words[-1])) and len(words[-1]) >= 4:
                self.given.add(words[0].lower())
                self.family.add(words[-1].lower())
        self.automaton = ahocorasick.Automaton()
        for hint, detector in HINTS.items():
            self.automaton.add_word(hint, (detector, 0))
        for name in self.family:
            self.automaton.add_word(name, ("family", len(name)))
        self.automaton.make_automaton()

    def hints(self, lower: str) -> tuple[set[str], list[tuple[int, int]]]:
        """What a text in lower case may hold, and the places of whole-word family names."""
        kinds, family, spelled = set(), [], 0
        for last, (kind, n) in self.automaton.iter(lower):
            if kind != "family":
                if kind == "spelled":
                    spelled += 1
                    if spelled < 5:  # fewer are no number
                        continue
                kinds.add(kind)
                continue
            a, b = last - n + 1, last + 1
            if a and (lower[a - 1].isalnum() or lower[a - 1] in "_.+@/-"):
                continue
            if b < len(lower) and (lower[b].isalnum() or lower[b] in "_@/+-(" or lower[b] == "." and lower[b + 1 : b + 2].isalnum()):
                continue
            family.append((a, b))
        return kinds, family


_before = re.compile(r"(?:(?:%s )?(?:[^\W\d_]+|[A-Za-z]\.) (?:[A-Za-z]\. )?|%s )$" % (_TITLE, _TITLE), re.I)
_no_person = re.compile(r"\b(?:project|street|road|function|module|class|host|server|branch|team|room|city|station)(?: [^\W\d_]+)? $", re.I)
_behind = re.compile(r", ([^\W\d_][\w'’-]+)")


def _names(text: str, names: NameParts, family: list[tuple[int, int]], hints: set[str], in_email: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    out = []
    for a, b in family:
        if in_email(a, b) or _no_person.search(text, max(0, a - 40), a):
            continue
        if m := _before.search(text, max(0, a - 40), a):
            first = m[0].split()[0].strip(".").lower()
            a = a if first in _NO_NAME or first in ("and", "by", "with", "from", "is", "ask", "to", "met") else m.start()
        if (m := _behind.match(text, b)) and m[1].lower() in names.given:
            b = m.end()
        out.append((a, b))
    for hint, regex in (("context", _name_context), ("full", _name_context_full), ("subject", _name_subject)):
        if hint in hints:
            for m in regex.finditer(text):
                words = re.findall(r"[^\W\d_]+", m[1].lower())
                if not in_email(*m.span(1)) and not _NO_NAME & set(words) and len(words) > 1:
                    out.append(m.span(1))
    if "title" in hints:
        out += [m.span() for m in _name_title.finditer(text) if not in_email(*m.span())]
    if "zh" in hints:
        out += [m.span() for m in _name_zh.finditer(text)] + [m.span(1) for m in _name_zh_context.finditer(text)]
    return out


_number = re.compile(r"[\d)][ .-]?\d[\d .()-]{3,}\d")
_no_number = re.compile(r"\b(?:build|version|release|rev|revision|run|epoch|ticket|batch|port|host|ref|order|invoice|sku|commit|session|编号|版本号?|批次|端口)\W{0,2}$", re.I)
_STREETS = tuple(f" {w}{end}" for w in _STREET.split("|") for end in (",", ".,", " in ", ". in "))
#: What the detectors cannot do without, by detector.
HINTS = {
    "@": "email", "(at)": "email", "[at]": "email", "{at}": "email", "<at>": "email", " dot ": "email",
    **dict.fromkeys(_STREETS, "address"), **dict.fromkeys("weg straße strasse str. gasse allee platz ufer damm 号".split(), "address"),
    **dict.fromkeys("tel phone mobile cell fax call text sms whatsapp on-call 电话 手机 致电 拨打 联系方式".split(), "phone"),
    **dict.fromkeys(("passport", "national id", "identity card", "id no", "tax id", "tax no", "tax number", "social security", "ssn", "身份证", "护照", "税号", "纳税人", "证件"), "id"),
    **dict.fromkeys(("my name is", "i am called", "name=", "| owner |", "signed", "forwarded message from", "hi, this is"), "context"),
    **dict.fromkeys(BEFORE_NAME, "full"), **dict.fromkeys((f" {x}" for x in AFTER_NAME), "subject"),
    **dict.fromkeys(("dr.", "mr.", "mrs.", "ms.", "mx.", "prof."), "title"),
    **dict.fromkeys(DIGIT_WORDS, "spelled"),
    **dict.fromkeys((*CJK_DOUBLE, "请联系", "联系人", "我叫", "我是", "昨天和", "今天和", "刚和", "负责人", "姓名", "收件人", "转告"), "zh"),
}


def _lower(text: str) -> str:
    """Lower case without changing the length."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def find(text: str, names: NameParts) -> list[Span]:
    """Spans of personal information in source characters, in order, without overlaps."""
    odd = not text.isascii() and bool(_odd.search(text))
    hints, family = names.hints(_lower(text))
    if not odd and not hints and not family and not _number.search(text):
        return []
    mapped = Mapped(text)
    if odd or "email" in hints or "spelled" in hints:
        mapped = normalise(text)
        if mapped.starts is not None:
            hints, family = names.hints(_lower(mapped.text))
    t = mapped.text
    found: list[tuple[int, int, str]] = []
    taken = lambda a, b: any(a < y and x < b for x, y, _ in found)
    if "@" in t:
        for m in [*_mailto.finditer(t), *_email.finditer(t)]:
            # a remote such as git@host:team/repo or a package such as name@1.2 is no address
            a, b = m.span(1) if m.re is _mailto else (m.start(1), m.end(2))
            if not taken(a, b):
                found.append((a, b, "email"))
    emails = list(found)
    in_email = lambda a, b: any(a < y and x < b for x, y, _ in emails)
    if "address" in hints:
        for regex in (_address, _address_de, _address_zh):
            for m in regex.finditer(t):
                if not taken(*m.span()) and not _no_address.search(t, m.end() - 1, m.end() + 12):
                    found.append((*m.span(), "address"))
    if _number.search(t):
        by = [(_ids, 0, "id_number")] + [(_id_context, 1, "id_number")] * ("id" in hints) + [(_phone, 0, "phone")] + [(_phone_context, 1, "phone")] * ("phone" in hints)
        for regex, group, kind in by:
            for m in regex.finditer(t):
                a, b = m.span(group)
                n = sum(c.isdigit() for c in m[group])
                if not taken(a, b) and (kind != "phone" or 7 <= n <= 20) and not _no_number.search(t, max(0, a - 16), a):
                    found.append((a, b, kind))
    for a, b in _names(t, names, family, hints, in_email):
        found.append((a, b, "name"))
    if not found:
        return []
    spans = sorted({Span(*mapped.span(a, b), kind) for a, b, kind in found if b > a}, key=lambda s: (s.start, -s.end))
    out: list[Span] = []
    for s in spans:
        if out and s.start < out[-1].end:
            if s.kind == out[-1].kind:
                out[-1] = Span(out[-1].start, max(out[-1].end, s.end), s.kind)
            elif s.end > out[-1].end:
                out.append(Span(out[-1].end, s.end, s.kind))
            continue
        out.append(s)
    return out


def redact_text(text: str, names: NameParts) -> str:
    """The text with typed placeholders such as ``[EMAIL]``; all else unchanged."""
    out, at = [], 0
    for s in find(text, names):
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


# --- over tables ------------------------------------------------------------------------


def known_persons(entities: DataFrame) -> list[str]:
    """Names of the persons among the entities, also of those without a type.

    Only names that look like a person's are kept.  The result goes to every task, so its
    size is checked: more than ``MAX_PERSONS`` is an error.
    """
    rows = (
        entities.where("name is not null and (entity_type = 'person' or entity_type is null)")
        .select(F.trim("name").alias("name")).where(F.col("name").rlike(r"^\p{Lu}[\p{L}'’-]+( \p{Lu}\.)?( \p{Lu}[\p{L}'’-]+)+$"))
        .distinct().limit(MAX_PERSONS + 1).collect()
    )
    if len(rows) > MAX_PERSONS:
        raise ValueError(f"more than {MAX_PERSONS} known persons; join them by family name instead")
    return sorted(r.name for r in rows)


def texts(events: DataFrame, sources: DataFrame, claims: DataFrame) -> DataFrame:
    """(rel, row_key, text) of event contents, source contents and evidence texts."""
    evidence = claims.select(F.explode("evidence").alias("e")).select(F.lit("vault_claims.evidence").alias("rel"), F.col("e.id").alias("row_key"), F.col("e.text").alias("text"))
    return (
        events.select(F.lit("agent_events").alias("rel"), F.col("id").cast("string").alias("row_key"), F.col("content").alias("text"))
        .unionByName(sources.select(F.lit("vault_sources").alias("rel"), F.col("id").alias("row_key"), F.col("content").alias("text")))
        .unionByName(evidence)
        .where("row_key is not null and text is not null and text <> ''")
    )


def found_kinds(texts: DataFrame, persons: list[str]) -> DataFrame:
    """(rel, row_key, kind): each kind of personal information each record has.

    Records delivered twice count once.  Null, empty and blank texts have none.
    """

    def make():
        names = NameParts(persons)

        def f(rels: list, keys: list, values: list):
            out: tuple[list, list, list] = ([], [], [])
            for rel, key, text in zip(rels, keys, values):
                for kind in {s.kind for s in find(text, names)}:
                    for column, value in zip(out, (rel, key, kind)):
                        column.append(value)
            return out

        return f

    return task_mapper(texts, [F.col(c) for c in ("rel", "row_key", "text")], "rel string, row_key string, kind string", make).distinct()


def redact(df: DataFrame, keys: list[str], text: str, persons: list[str]) -> DataFrame:
    """(keys..., text, found): the texts with placeholders and the number of spans replaced.

    Null texts stay null; empty and clean ones come out unchanged.
    """

    def make():
        names = NameParts(persons)

        def f(*lists: list):
            values = lists[-1]
            spans = [find(t, names) if t else [] for t in values]
            return (*lists[:-1], [redact_text(t, names) if s else t for t, s in zip(values, spans)], [len(s) for s in spans])

        return f

    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + f"`{text}` string, found int"
    return task_mapper(df, [F.col(f"`{c}`") for c in (*keys, text)], schema, make)
