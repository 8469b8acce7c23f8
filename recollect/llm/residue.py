"""Template residue, filler, error pages and notices that scripts are needed.

Method: positive-unlabelled naive Bayes.  Records are cut into passages: the sentences
outside code blocks, and each slot of a template with the words beside it.  Passages that
are trusted residue (an open slot that is not quoted, a standard error line, filler known
as such) are the positives, quoted slots are content, all others are unlabelled.
Expectation-maximisation learns from a bounded sample how much more often each word, pair
of words and form stands in residue than in content: the unlabelled passages' posteriors
are re-estimated until they settle, so that lines that share the words of trusted ones
join them.  Every passage of the corpus is then scored with the model alone: trust counts
for nothing in the score, it only labels the sample.  A record is residue if one of its
passages is more likely residue than not.

Residue may stand at the edge of a content line, so a passage's score is the best of the
whole, its beginnings and its ends.  Quoted spans count as one form each, whatever they say.

The documented bound of the fit is ``SAMPLE`` records, chosen by hash from the whole
corpus, with at most ``FORMS`` distinct passages.  A sample keeps the corpus' proportions,
so the model does not depend on how large the corpus is.  Scoring covers every passage of
every record.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.arrow import task_mapper

#: At most so many records are fitted on, with at most so many distinct passages.
SAMPLE, FORMS = 20_000, 200_000
ROUNDS = 12
#: Share of the unlabelled passages expected to be residue, before any evidence.
PRIOR = 0.002
#: Log-odds from which on a passage is residue: it is more likely so than not.
THRESHOLD = 0.0
#: Seen so often in residue, as a share of one passage, is what was never seen there.
SMOOTHING = 0.02
#: One feature's log-odds are at most so large.
BOUND = 6.0
#: Words and pairs overlap, so each counts half.
HALF = 0.5
#: Words of the least beginning or end of a passage that is scored apart.
EDGE = 4
#: Verdicts a task remembers, so as not to judge a passage twice.
MEMO = 50_000

# --- open slots -------------------------------------------------------------------------

_NAME = r"[\w .:|'-]{1,60}?"
#: The notations of slots that a program or an author was to fill.
SLOT = re.compile(
    r"\{\{\s*[^{}\n]{1,60}\}\}|\{%-?\s*\w+[^%\n]{0,60}%\}|<%[=-]?[^%\n]{1,60}%>|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|\$\([A-Za-z_]\w{1,40}\)\$"
    r"|%%\w{2,40}%%|@@\w{2,40}@@|(?<![A-Za-z0-9_])__[A-Z][A-Z0-9_]{2,40}__(?![A-Za-z0-9_])|<<[^<>\n]{2,60}>>"
    r"|<(?:your|insert|enter|add|name of)\b[^<>\n]{1,60}>|\[(?:insert|enter|add|fill|your)\b[^\[\]\n]{1,60}\]|\[[^\[\]\n]{1,40}\b(?:TBD|TODO|TBA|here|goes here)\]"
    r"|_{5,}\s*[(（][^()（）\n]{1,60}[)）]"
    r"|[【《（(\[]?\s*(?:请在此|在此处?|此处)(?:填写|插入|输入)[^】》）)\]\n]{0,20}[】》）)\]]|[《【][^《》【】\n]{0,10}待(?:填写|补充|定)[^《》【】\n]{0,10}[》】]|[XＸ]{2,}\s*[（(]填写[^）)\n]{0,12}[）)]",
    re.I,
)
#: Slots that only their capitals tell from a reference.
TITLED_SLOT = re.compile(r"\[(?:[A-Z][a-z]+ ){1,3}(?:Name|Date|Title|Number|Address|Email|Company|City|Owner|Place|Here)\]")
#: What every slot has one of.
_slot_mark = re.compile(r"\{\{|\{%|<|[$#]\{|\$\(|%%|@@|__|\[|【|《|在此|此处|填写")

#: Lines that servers, viewers and templates put where content should be.
_ERROR = (
    r"^(?:error )?(?:4\d\d|5\d\d)[ :-]+(?:not found|bad gateway|forbidden|unauthori[sz]ed|service unavailable|internal server error|gateway time-?out|too many requests|bad request|gone)\b.{0,40}$",
    r"^(?:internal server error|bad gateway|service unavailable|gateway time-?out|too many requests|access denied|permission denied|page not found|not found|forbidden)\b[.!]?(?: \(attempt \d+ of \d+\))?(?: [^\"“”]{0,80})?$",
    r"^upstream timed out\b.*",
    r"^\{\s*\"error\"\s*:\s*(?:\{|\").*",
    r"^oops!?(?: something went wrong.*)?$|^something went wrong\b.{0,40}$",
    r"^your session has expired\b.{0,40}$|^sign in again to continue\b.{0,10}$",
    r"^you (?:lack|do not have|don't have) permission\b.{0,60}$",
    r"^we couldn'?t find what you were looking for\b.{0,20}$|^the (?:page|file|note|document) (?:you asked for|you requested|at \S+)\b.{0,30}(?:could not be located|moved or deleted|not found|does not exist).{0,5}$",
    r"^this (?:page|site|vault|service) is (?:temporarily )?(?:unavailable|down)\b.{0,60}$",
    r"^(?:系统繁忙|服务器(?:错误|繁忙)|网络异常).{0,30}$|^(?:抱歉|对不起)?[，,]?(?:您访问的|该|此)?(?:页面|文档|内容)(?:不存在|已删除|无法访问|找不到).{0,12}$|^无权访问.{0,24}$|^登录已过期.{0,16}$",
)
_SCRIPT = (
    r"^(?:please )?(?:enable|turn on|allow) (?:javascript|js|scripts|cookies)\b.{0,60}$",
    r"^(?:javascript|scripts?|cookies(?: and scripts)?) (?:is|are|must be|needs? to be) (?:disabled|required|on|enabled|turned on)\b.{0,60}$",
    r"^loading(?:…|\.\.\.).{0,10}(?:if nothing appears.*)?$",
    r"^(?:checking your browser|verify(?:ing)? that you are (?:not a robot|human)|verify you are human)\b.{0,60}$",
    r"^your browser is not supported\b.{0,40}$|^this (?:viewer|site|page|reader) (?:does not work|needs?|requires?)\b.{0,30}\b(?:scripts?|javascript)\b.{0,30}$",
    r"^<noscript>.*",
    r"^请(?:先)?(?:启用|开启|打开)\s?(?:javascript|脚本).{0,20}$|^(?:您|你)的浏览器不支持.{0,24}$|^(?:正在检查|请完成)(?:您的浏览器|人机验证|安全验证).{0,20}$",
)
_FILLER = (
    r"^lorem ipsum dolor\b.*",
    r"^(?:sample text\W*){2,}$|^(?:body copy|headline|your text|text|content|title) goes here\b.{0,20}$|^replace this (?:paragraph|text)\b.{0,40}$|^this is (?:a )?(?:dummy|placeholder|sample|filler) (?:paragraph|text|copy)\b.*",
    r"^(?:x{2,}\s*){3,}$|^(?:(?:asdf|qwer|jkl;?|zxcv|hjkl|fdsa|uiop)\s*){3,}$|^(?:test\s*){2,}(?:\d+\s*)?(?:test\s*)*$|^(?:blah\s*){2,}$",
    r"^(?:此处为示例文字[，,。]?)+$|^这里是占位(?:内容|文字).{0,12}$|^(?:测试){2,}.{0,12}$|^.{0,6}随便写点内容.{0,3}$",
)
SEEDS = [(kind, re.compile("|".join(f"(?:{p})" for p in patterns), re.I)) for kind, patterns in (("error", _ERROR), ("script", _SCRIPT), ("filler", _FILLER))]

#: A passage that holds all of these words is filler (fixed values).
FILLER_WORDS = frozenset(("lorem", "ipsum", "dolor"))

# --- quoting ----------------------------------------------------------------------------

_quoted = re.compile(r"`[^`\n]+`|\"[^\"\n]{3,160}\"|“[^”\n]{2,160}”|「[^」\n]{2,160}」|'[^'\n]{6,160}'")
_fence = re.compile(r"^\s*(?:```|~~~)")
_lead = re.compile(r"^(?:\s|[-*+>#|•]|\d+[.)]\s)+|[\s|]+$")
_tag = re.compile(r"</?(?:html|head|title|body|div|p|h\d|span|main|section|center)\b[^<>]*>", re.I)
_splitter = re.compile(r"(?<=[a-z0-9)\]}>%_\"'][.!?])\s+(?=\S)|(?<=[。！？])")
_invisible = re.compile(r"[​-‏⁠﻿­]")
#: Names of things, which say nothing about a passage: paths, addresses, identifiers, hashes.
_name_of = re.compile(r"(?<![A-Za-z0-9.:-])[A-Za-z0-9.:-]*+[/_][\w./:-]*+|(?<![A-Za-z0-9])(?=[a-f]*\d)[a-f0-9]{6,}+(?![A-Za-z0-9])", re.A)
_name_mark = re.compile(r"[/_\d]")
_words = re.compile(r"§\w+|[一-鿿]|[^\W\d_一-鿿]+(?:'[a-z]+)?|\d+")

#: What is scored: (features, kind of trusted residue or '').
Unit = tuple[list[str], str]


def passages(text: str) -> list[str]:
    """Rows outside code blocks, without marks and tags, each also by its sentences."""
    out: list[str] = []
    fenced = False
    for row in _tag.sub("\n", _invisible.sub("", text.replace("\r", "\n"))).split("\n"):
        if _fence.match(row):
            fenced = not fenced
            continue
        if fenced:
            continue
        row = " ".join(_lead.sub("", row).split())
        if row:
            out += [s for s in _splitter.split(row) if s.strip()]
    return out


_quote_mark = re.compile("[`\"“「']")


def words(text: str) -> list[str]:
    """The words in order; names of things, numbers, slots and quoted spans as forms."""
    if _name_mark.search(text):
        text = _name_of.sub(" §id ", text)
        return ["§n" if w.isdigit() else w for w in _words.findall(unicodedata.normalize("NFC", text.lower()))]
    return _words.findall(unicodedata.normalize("NFC", text.lower()))


def _quotes(passage: str) -> list[tuple[int, int]]:
    """Spans of quoted text and code."""
    return [m.span() for m in _quoted.finditer(passage)] if _quote_mark.search(passage) else []


def slots(passage: str) -> list[tuple[int, int]]:
    """Spans of slots, open or quoted."""
    if not _slot_mark.search(passage):
        return []
    return sorted(m.span() for regex in (SLOT, TITLED_SLOT) for m in regex.finditer(passage))


def masked(passage: str) -> list[str]:
    """The words of a passage, with quoted spans and slots as one word each.

    A body of braces is data as it stands: its quotation marks quote nothing.
    """
    if not passage.startswith("{") and _quote_mark.search(passage):
        passage = _quoted.sub(" §quote ", passage)
    if _slot_mark.search(passage):
        passage = TITLED_SLOT.sub(" §open ", SLOT.sub(" §open ", passage))
    return words(passage)


def _shape(n: int) -> str:
    """The form of a passage of ``n`` words."""
    return f"§len{min(6, n // 4)}"


def features(passage: str) -> list[str]:
    """Words, pairs of words, also with the passage's ends, and its length."""
    own = masked(passage)
    return sorted({*own, *(f"{a} {b}" for a, b in zip(["^", *own], [*own, "$"])), _shape(len(own))})


def slot_features(passage: str, span: tuple[int, int], quoted: bool) -> list[str]:
    """A slot's notation, the words beside it, and whether it is quoted."""
    a, b = span
    before, after = words(passage[:a])[-1:], words(passage[b:])[:1]
    out = {"§slot", "§notation " + re.sub(r"[\w\s]", "", passage[a:b])[:2], "§before " + "".join(before), "§after " + "".join(after)}
    return sorted(out | {"§quoted"}) if quoted else sorted(out)


def trusted(passage: str) -> str:
    """'error', 'script', 'filler' or '': the kind of a line that is residue as such."""
    if passage[:1] in "\"'`“「":
        return ""
    for kind, regex in SEEDS:
        if regex.search(passage):
            return kind
    return "filler" if FILLER_WORDS <= set(masked(passage)) else ""


def _slot_units(passage: str) -> list[Unit]:
    spans, quotes = slots(passage), _quotes(passage)
    quoted = [any(x <= a and b <= y for x, y in quotes) for a, b in spans]
    return [(slot_features(passage, s, q), "" if q else "slot") for s, q in zip(spans, quoted)]


def units(passage: str) -> list[Unit]:
    """The slots of a passage and the passage itself, which says nothing of its slots' kind."""
    return [*_slot_units(passage), (features(passage), trusted(passage))]


class Model:
    """Log-odds of features; ``rest`` is that of features hardly ever met."""

    def __init__(self, weights: dict[str, float], bias: float, rest: float = 0.0):
        self.weights, self.bias, self.rest = weights, bias, rest
        self._hopeful = {f for f, w in weights.items() if w > 0 and not f.startswith("§len")}
        #: No passage without one of these words has a hopeful feature.
        self._words = {w for f in self._hopeful for w in f.split(" ")[:1] if w != "^"} | {f.split(" ")[1] for f in self._hopeful if f.startswith("^ ")}
        self._met: dict[str, tuple[str, float]] = {}

    def score(self, found: list[str]) -> float:
        """Log-odds of a passage's features."""
        return self.bias + HALF * sum(self.weights.get(f, self.rest) for f in found)

    def passage(self, own: list[str]) -> float:
        """Log-odds of a passage's words: the best of the whole, its beginnings and its ends."""
        if self._words.isdisjoint(own):
            return self.bias
        pairs = [f"{a} {b}" for a, b in zip(["^", *own], [*own, "$"])]
        if self._hopeful.isdisjoint(own) and self._hopeful.isdisjoint(pairs):
            return self.bias
        get, rest = self.weights.get, self.rest
        best = sum(get(f, rest) for f in {*own, *pairs, _shape(len(own))})
        word, pair = [get(w, rest) for w in own], [get(p, rest) for p in pairs]
        head = tail = 0.0
        for i in range(len(own) - 1):
            head += word[i] + pair[i]
            tail += word[-1 - i] + pair[-1 - i]
            if i >= EDGE - 1:
                best = max(best, head, tail)
        return self.bias + HALF * best

    def verdict(self, passage: str) -> tuple[str, float]:
        """(kind, score) of a passage: the kind of its best part, 'learnt' if that is not trusted.

        Passages come again and again, so verdicts on the last ``MEMO`` are kept.
        """
        if (met := self._met.get(passage)) is None:
            if len(self._met) >= MEMO:
                self._met.clear()
            met = self._met[passage] = self._judge(passage)
        return met

    def _judge(self, passage: str) -> tuple[str, float]:
        kind, score = "", self.passage(masked(passage))
        for found, slot in _slot_units(passage):
            if (s := self.score(found)) > score:
                kind, score = slot, s
        return (kind or trusted(passage) or "learnt") if score > THRESHOLD else "", score


def fit(forms: list[list[str]], weights: list[float], positive: list[bool], rounds: int = ROUNDS) -> Model:
    """Positive-unlabelled naive Bayes by expectation-maximisation.

    ``forms`` are the passages' features, ``weights`` how often each occurs, ``positive``
    the trusted ones, whose posterior stays 1; that of quoted slots stays 0.  The prior of an
    unlabelled passage is the share of residue among the unlabelled.  All evidence is relative:
    weights a hundred times as large give the same model, but for the smoothing of rare words.
    No trusted passage: nothing is residue.
    """
    if not any(positive):
        return Model({}, -10.0)
    known = np.array(positive)
    never = np.array(["§quoted" in f for f in forms])
    w = np.array(weights, dtype=float)
    count: Counter = Counter()
    for f, n, y in zip(forms, weights, positive):
        for x in f:
            count[x] += 2 * n if y else n
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, n in count.items() if n >= 2))}
    at = [(r, i) for r, f in enumerate(forms) for x in f if (i := vocabulary.get(x)) is not None]
    r, c = np.array(at, dtype=np.int64).reshape(-1, 2).T
    n = len(vocabulary)
    rare = np.array([sum(x not in vocabulary for x in f) for f in forms])
    post, share = known.astype(float), PRIOR
    for _ in range(rounds):
        p, q = w * post, w * (1 - post)
        yes, no = np.bincount(c, weights=p[r], minlength=n), np.bincount(c, weights=q[r], minlength=n)
        ratio = q.sum() / p.sum()
        odds = np.log((yes + SMOOTHING) / (p.sum() + 1)) - np.log((no + SMOOTHING * ratio) / (q.sum() + ratio))
        odds = np.clip(odds, -BOUND, BOUND)
        # a word met once, in content
        rest = math.log(SMOOTHING / (p.sum() + 1)) - math.log((1 + SMOOTHING * ratio) / (q.sum() + ratio))
        s = math.log(share / (1 - share)) + HALF * (np.bincount(r, weights=odds[c], minlength=len(forms)) + rest * rare)
        new = np.where(known, 1.0, np.where(never, 0.0, 1 / (1 + np.exp(-np.clip(s, -40, 40)))))
        settled = np.abs(new - post).max() < 1e-4
        post = new
        if not known.all():
            share = min(0.5, max(1e-4, float((w * post)[~known].sum() / w[~known].sum())))
        if settled:
            break
    residue_share = min(0.5, max(1e-4, float((w * post).sum() / w.sum())))
    return Model(dict(zip(vocabulary, odds.round(4).tolist())), math.log(residue_share / (1 - residue_share)), round(rest, 4))


def learn(documents: DataFrame, text: str = "text", sample: int = SAMPLE, forms: int = FORMS) -> Model:
    """The model of a corpus, fitted on about ``sample`` of its records, at most ``forms`` distinct passages.

    Records are chosen by the hash of their text, so the sample does not depend on the order
    of rows and holds the kinds of passages in the corpus' proportions.  Its passages are
    counted by their features; only the distinct ones reach the driver.
    """
    rows = documents.select(F.col(f"`{text}`").alias("text")).where("text is not null")
    share = sample / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("text"), 11) < F.lit(int(share * (1 << 53))))

    def make() -> Callable:
        def f(texts: list):
            found: Counter = Counter()
            for t in texts:
                for p in passages(t):
                    for own, kind in units(p):
                        found["\x1f".join(own), bool(kind)] += 1
            return [k for k, _ in found], [y for _, y in found], list(found.values())

        return f

    counted = task_mapper(rows, [F.col("text")], "form string, positive boolean, n bigint", make)
    counted = counted.groupBy("form", "positive").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("form"), "form", "positive").limit(forms)
    chosen = sorted((r.form, r.positive, r.n) for r in counted.collect())
    return fit([r[0].split("\x1f") for r in chosen], [r[2] for r in chosen], [r[1] for r in chosen])


def judge(text: str | None, model: Model, threshold: float = THRESHOLD) -> list[tuple[str, float, str]]:
    """(passage, score, kind) of the residue passages of a record."""
    out = []
    if not text or not text.strip():
        return out
    for p in passages(text):
        kind, score = model.verdict(p)
        if score > threshold:
            out.append((p, round(score, 3), kind))
    return out


def residue(documents: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, passages, score, kind): the records that hold residue.

    ``passages`` counts their residue passages, ``score`` is the highest log-odds and
    ``kind`` the kind of that passage ('learnt' if only the model knows it).  Null, empty and
    blank texts hold none; repeated rows stay repeated.
    """
    model = model or learn(documents, text)

    def make() -> Callable:
        def f(keys: list, texts: list):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k, t in zip(keys, texts):
                if found := judge(t, model):
                    _, score, kind = max(found, key=lambda x: x[1])
                    for column, value in zip(out, (k, len(found), score, kind)):
                        column.append(value)
            return out

        return f

    kind = documents.schema[key].dataType.simpleString()
    return task_mapper(documents, [F.col(f"`{key}`"), F.col(f"`{text}`")], f"`{key}` {kind}, passages int, score double, kind string", make)


def clean(documents: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The records without residue, all columns; records with a null key are kept."""
    found = residue(documents, model, key, text).select(F.col(key).alias("__residue")).where("__residue is not null").distinct()
    return documents.join(found, documents[key] == found["__residue"], "left_anti")
