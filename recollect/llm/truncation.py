"""Texts cut off by field limits and broken transfers.

Method, in four steps over all texts of all origins (an origin is an agent or a store: whoever
writes a field sets its limit; a source's texts come from several of them):

1. Lengths.  Each origin's length histogram is fitted by maximum likelihood with a
   log-normal distribution that is right-censored at a candidate limit: lengths at the
   limit only say "at least so long".  The posterior of a text at the limit being censored
   is one minus the share of such texts that the fitted density explains.
2. Endings.  How a text ends is compared with how sentences end in the corpus: counts of
   (first words, last words) of sentences that are surely complete (closed by punctuation,
   or followed by another line), of open endings, and of open line openings.  This sorts
   endings into a few kinds.
3. Evidence.  A text whose last sentence is closed broke off in none, so only the others
   are asked about.  How often cut ones end in each kind is learned from the texts at the
   limits, weighted by their censoring posteriors; how often complete ones do, from the rest:
   a complete sentence without its stop ends like those that have it, and ends newly as
   often as any sentence does, which the endings met once tell (Good-Turing).
   A text off the limits may have lost its end in a transfer: how many did is the share that
   makes the others' endings most likely (expectation-maximisation; a handful of counts).
   Truncation marks and broken characters say by themselves that something was lost.
4. Decision.  A text's posterior of being cut joins its length's posterior (off the limits,
   the share of broken transfers) with its ending's evidence.

The histograms and counts are aggregates with partial results over the whole corpus; only
texts with an open ending are joined with them, spread by their ending, so no group of
rows is ever brought together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.arrow import task_mapper
from recollect.session import cut_lineage

#: A candidate limit is a length that occurs so many times as often as the lengths around it,
#: and whose excess over the fitted density has so much log-likelihood, besides the logarithm
#: of the number of lengths that could have been one.
LIMIT_RATIO, LIMIT_EXCESS = 6.0, 4.0
#: Share of broken transfers among the unclosed texts off the limits, before any evidence.
TRANSFER = 0.05
#: How unclosed texts end that are cut, and that are complete, before any evidence, and as how
#: many texts that counts.
PRIOR_TEXTS = 10.0
PRIOR_ENDINGS = {
    "open": (0.92, 0.02),  # words that no complete sentence of this opening ends in
    "seen": (0.05, 0.18),  # like complete sentences that open alike
    "line": (0.005, 0.795),  # a row that opens like rows that have no closing punctuation
    "fence": (0.025, 0.005),  # inside a code block
}
#: Log-odds of endings that say themselves that something was lost: a broken character, and a
#: truncation mark on what is no repeated row.
SELF_EVIDENT = {"broken": 12.0, "marked": 9.0}
ROUNDS = 500

#: Shares, smoothed by one row: below the first of its rows closed, an opening is of lines; from
#: the second on of its other rows ending alike, a close repeats; from the third on of its ends
#: complete, a close is one of complete sentences; from the fourth on of its rows closed, an
#: opening is one that punctuation closes.
SELDOM, REPEATS, COMPLETE, CLOSED_SHARE = 0.2, 0.2, 0.8, 0.5

_digits = re.compile(r"\d+(?:[.,]\d+)*")
_ident = re.compile(r"`[^`]*`|https?://[^\s，。]+|(?:[A-Za-z0-9_-]+/)+[A-Za-z0-9_.-]+|[A-Za-z0-9]+_[A-Za-z0-9_]+")
_word = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+(?:[-'][^\W_]+)*|[^\w\s]")
_cjk = re.compile(r"[぀-ヿ㐀-鿿가-힯]$")
_stop = re.compile(r"(?<=[a-z0-9)\]\"'”’`%])[.!?](?=\s+\S)|[。！？](?=.)|[.!?](?=\s+[A-Z㐀-鿿])")
_wide = re.compile("[０-９Ａ-Ｚａ-ｚ]")
_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_mark = re.compile(r"(?:…|\.{3,}|\[(?:\.{3}|…|truncated|cut|snip)[^\]]*\]|\((?:truncated|cut off|continued)\))\s*$", re.I)
_closed = re.compile(r"(?:[.!?。！？;；|}>]|```|[.!?。！？;][\"'”’*_)\]」』）】]+|[\"'”’]\s*[.!?])\s*$")
_bullet = re.compile(r"^\s*(?:[-*+>#|•]+|\d+[.)])\s+")
_emoji = re.compile(r"[☀-➿\U0001f300-\U0001faff️]\s*$")
_path = re.compile(r"(?:^|\s)(?:[\w.-]+/)+[\w-]+\.\w{1,5}$|https?://\S*\w$|\)$|\*\*$|`$|_$")


def _masked(sentence: str) -> list[str]:
    text = _ident.sub("I", sentence)
    return _word.findall(_digits.sub("0", text).casefold())


def ends(sentence: str) -> tuple[str, str, str, str]:
    """The opening and the close of a sentence, both close and loose.

    Close: the first two and the last two words; loose: the first and the last three.  In
    scripts without spaces the close has four characters, the loose close six.  Names,
    numbers and paths are masked, marks are left out.
    """
    words = [w for w in _masked(sentence) if w[-1].isalnum()]
    n = 4 if words and _cjk.match(words[-1]) else 2
    return " ".join(words[:2]), " ".join(words[-n:]), " ".join(words[:1]), " ".join(words[-n - n // 2 :])


def sentences(text: str) -> tuple[list[str], list[str], str]:
    """(closed, lines, tail): sentences closed by punctuation, lines that end without it
    but are followed by another line, and the last open piece ('' if the text is closed)."""
    closed, lines, tail = [], [], ""
    rows = text.rstrip().split("\n")
    fenced = False
    for i, row in enumerate(rows):
        if row.lstrip().startswith("```"):
            fenced = not fenced
            continue
        if fenced:
            continue
        at = 0
        for m in _stop.finditer(row):
            closed.append(row[at : m.start()])
            at = m.end()
        rest = row[at:].strip()
        if not rest:
            continue
        if _closed.search(rest):
            closed.append(rest)
        elif i < len(rows) - 1:
            lines.append(rest)
        else:
            tail = rest
    if fenced and not tail:
        tail = rows[-1]
    return closed, lines, tail


def ending(text: str) -> tuple[str, str, bool]:
    """(kind, piece, row): how a text ends, its last open piece without list marks, and
    whether that piece is all of its row.

    Kinds: 'blank', 'closed', 'broken', 'marked', 'fence' (inside a code block) and 'open'.
    """
    bare = text.rstrip()
    if not bare:
        return "blank", "", False
    if bare.endswith("�"):
        return "broken", "", False
    if _mark.search(bare):
        rest = _mark.sub("", bare).rstrip()
        return "marked", _bullet.sub("", sentences(rest)[2]), "\n" not in rest and not _stop.search(rest)
    if _closed.search(bare) or _emoji.search(bare):
        return "closed", "", False
    _, _, tail = sentences(bare)
    if bare.count("```") % 2:
        return "fence", tail, False
    piece = _bullet.sub("", tail)
    return ("open", piece, tail == bare.rsplit("\n", 1)[-1].strip()) if piece else ("closed", "", False)


def _scan() -> Callable:
    """Rows of three kinds from a batch: 'text' (an open or marked text), 'n' (counts of
    sentence ends, added up within the batch) and 'len' (counts of lengths)."""

    def f(rels: list, keys: list, origins: list, texts: list):
        done, lengths = Counter(), Counter()
        out: list[tuple] = []
        for rel, key, origin, text in zip(rels, keys, origins, texts):
            if text is None or not text.strip():
                continue
            n = len(text)
            lengths[rel, origin, n] += 1
            if _wide.search(text):
                text = text.translate(_NARROW)
            closed, lines, _ = sentences(text)
            for s in closed:
                a, b, a1, b3 = ends(s)
                done["done", a, b] += 1
                done["loose", a1, b3] += 1
                done["any", "", b] += 1
                done["stops", a, ""] += 1
            for s in lines:
                a, b, a1, b3 = ends(_bullet.sub("", s))
                done["done", a, b] += 1
                done["loose", a1, b3] += 1
                done["any", "", b] += 1
                done["lines", a, ""] += 1
            kind, piece, row = ending(text)
            if kind not in ("closed", "blank"):
                a, b, a1, b3 = ends(piece)
                if kind in ("open", "marked"):
                    done["alike", a, b] += 1
                    done["alike3", a1, b3] += 1
                    done["lines", a, ""] += row
                out.append(("text", rel, key, origin, n, kind, a, b, a1, b3, bool(_path.search(piece)), row, 1))
        for (kind, a, b), c in done.items():
            out.append(("n", None, None, None, None, kind, a, b, None, None, None, None, c))
        for (rel, origin, n), c in lengths.items():
            out.append(("len", rel, None, origin, n, None, None, None, None, None, None, None, c))
        return tuple(list(x) for x in zip(*out)) if out else ([],) * 13

    return f


SCAN = "row string, rel string, key string, origin string, n int, kind string, opens string, closes string, opens1 string, closes3 string, path boolean, own_row boolean, c bigint"


def log_normal_censored(lengths: np.ndarray, counts: np.ndarray, limit: int, rounds: int = 60) -> tuple[float, float]:
    """Maximum likelihood of a log-normal, right-censored at ``limit``, by expectation-maximisation.

    Observed lengths are those below the limit; all at or above are known only as such.
    """
    x, w = np.log(lengths + 0.5), counts.astype(float)
    seen = lengths < limit
    if not seen.any():
        return math.log(limit + 0.5), 1.0
    cut, lost = math.log(limit), float(w[~seen].sum())
    xs, ws = x[seen], w[seen]
    total = ws.sum() + lost
    mu = float((xs * ws).sum() / ws.sum())
    sigma = max(0.05, float(np.sqrt((ws * (xs - mu) ** 2).sum() / ws.sum())))
    for _ in range(rounds):
        z = (cut - mu) / sigma
        tail = max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))
        hazard = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        mean = mu + sigma * hazard  # of a censored value, and of its square below
        square = sigma**2 * (1 + z * hazard - hazard**2) + mean**2
        new = float(((xs * ws).sum() + lost * mean) / total)
        sigma = max(0.05, math.sqrt(max(1e-6, float(((xs**2) * ws).sum() + lost * square) / total - new**2)))
        if abs(new - mu) < 1e-7:
            break
        mu = new
    return mu, sigma


def censoring(lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, float]]:
    """(limit, posterior) of each candidate limit in a histogram of lengths."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    total = counts.sum()
    out = []
    needed = LIMIT_EXCESS + math.log(len(lengths) or 1)
    excess = lambda n, expected: n * math.log(n / expected) - n + expected if n > expected else 0.0
    for i in np.nonzero(counts >= 2)[0]:  # a length that occurs once has no excess
        limit, n = int(lengths[i]), int(counts[i])
        if n <= counts[i + 1 :].sum():  # most of what is beyond a limit stands at it
            continue
        near = (np.abs(lengths - limit) <= 12) & (lengths != limit)
        around = counts[near].sum() / 24
        if n < LIMIT_RATIO * around or excess(n, max(around, 1 / 24)) < needed:
            continue
        mu, sigma = log_normal_censored(lengths, counts, limit)
        z = (math.log(limit + 0.5) - mu) / sigma
        density = math.exp(-0.5 * z * z) / (sigma * math.sqrt(2 * math.pi)) / (limit + 0.5)
        explained = max(density * total, around, 1e-6)
        if excess(n, explained) < needed:
            continue
        out.append((limit, min(0.999, max(0.001, 1 - explained / n))))
    return out


def limits(lengths: DataFrame) -> DataFrame:
    """(rel, origin, n, posterior): the censoring posterior at each origin's limits.

    ``lengths`` has (rel, origin, n, c), one row per length, so a group is at most as long as
    the longest text, however many rows the origin has.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        found = censoring(pdf.n.to_numpy(), pdf.c.to_numpy())
        return pd.DataFrame({"rel": pdf.rel.iloc[0], "origin": pdf.origin.iloc[0], "n": [x for x, _ in found], "posterior": [p for _, p in found]})

    return lengths.groupBy("rel", "origin").applyInPandas(fit, "rel string, origin string, n int, posterior double")


def decide(texts: DataFrame) -> DataFrame:
    """(rel, key, origin, n, kind, posterior, score): log-odds that the text was cut, for each text
    that does not end closed; ``posterior`` is that of its length, null off the limits.  ``texts`` has (rel, key, origin, text), all strings."""
    scanned = cut_lineage(task_mapper(texts, [F.col(c) for c in ("rel", "key", "origin", "text")], SCAN, _scan))
    counts = scanned.where("row = 'n'").groupBy("kind", "opens", "closes").agg(F.sum("c").alias("c"))

    def of(kind: str, **by: str) -> DataFrame:
        return counts.where(F.col("kind") == kind).select(*(F.col(old).alias(new) for old, new in by.items()), F.col("c").alias(kind))

    open_closes = counts.where("kind = 'alike'").groupBy("closes").agg(F.sum("c").alias("open_closes"))
    lengths = scanned.where("row = 'len'").groupBy("rel", F.coalesce("origin", F.lit("")).alias("origin"), "n").agg(F.sum("c").alias("c"))
    open_texts = scanned.where("row = 'text'").withColumn("origin", F.coalesce("origin", F.lit(""))).drop("row", "c")
    both, loose = {"opens": "opens", "closes": "closes"}, {"opens": "opens1", "closes": "closes3"}
    found = limits(lengths)
    x = (
        open_texts.join(found, ["rel", "origin", "n"], "left")
        .join(of("done", **both), ["opens", "closes"], "left")
        .join(of("alike", **both), ["opens", "closes"], "left")
        .join(of("loose", **loose), ["opens1", "closes3"], "left")
        .join(of("alike3", **loose), ["opens1", "closes3"], "left")
        .join(of("stops", opens="opens"), "opens", "left")
        .join(of("lines", opens="opens"), "opens", "left")
        .join(of("any", closes="closes"), "closes", "left")
        .join(open_closes, "closes", "left")
    )
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0))
    # what other texts say: a piece doesn't count itself
    own = F.col("kind").isin("open", "marked").cast("int")
    others = lambda c, one=own: F.greatest(n0(c) - one, F.lit(0))
    rows = others("lines", own * F.col("own_row").cast("int"))
    unclosed = rows / (rows + n0("stops") + 1)
    complete = n0("any") / (n0("any") + others("open_closes") + 1)
    # an opening is of lines if punctuation hardly ever closes it, and this close repeats
    repeats = (others("alike") >= REPEATS * (rows + 1)) | (F.col("path") & (unclosed >= 0.5)) | ((complete >= COMPLETE) & (unclosed >= 0.5))
    line = F.col("own_row") & (n0("stops") < SELDOM * (rows + 1)) & repeats
    # one row more, so that a single meeting of words decides nothing
    ends_alike = (n0("done") > others("alike") + 1) | (n0("loose") > others("alike3") + 1)
    # an opening that is not known to be closed by punctuation: the close alone must do
    seen = ends_alike | (F.col("own_row") & (n0("stops") < CLOSED_SHARE * (rows + n0("stops") + 1)) & (complete >= COMPLETE))
    how = (
        F.when(F.col("kind").isin("broken", "fence"), F.col("kind"))
        .when(F.col("kind") == "marked", F.when(line, "line").otherwise("marked"))
        .when(line, "line")
        .when(seen, "seen")
        .otherwise("open")
    )
    x = cut_lineage(x.select("rel", "key", "origin", "n", F.col("posterior").alias("p"), how.alias("kind")))
    evidence, transfer = fit_endings(ending_counts(x), new_endings(counts))
    off = F.lit(math.log(TRANSFER / (1 - TRANSFER)))
    for rel, odds in transfer.items():
        off = F.when(F.col("rel") == rel, F.lit(odds)).otherwise(off)
    says = F.lit(0.0)
    for kind, odds in SELF_EVIDENT.items():
        says = F.when(F.col("kind") == kind, F.lit(odds)).otherwise(says)
    for (rel, kind), odds in evidence.items():
        says = F.when((F.col("rel") == rel) & (F.col("kind") == kind), F.lit(odds)).otherwise(says)
    p = F.col("p")
    return x.select("rel", "key", "origin", "n", "kind", p.alias("posterior"), (F.coalesce(F.log(p / (1 - p)), off) + says).alias("score"))


def ending_counts(texts: DataFrame) -> list[tuple[str, float | None, str, int]]:
    """(rel, posterior, ending, count) of the unclosed, unmarked texts (rel, p, kind); the posterior is null off the limits.

    Posteriors are rounded to thousandths, so however many origins there are, a relation has
    at most a thousand rows for each kind of ending.
    """
    counts = texts.where(F.col("kind").isin(*PRIOR_ENDINGS)).groupBy("rel", F.round("p", 3).alias("p"), "kind").agg(F.count("*").alias("c"))
    return sorted(((r.rel, r.p, r.kind, r.c) for r in counts.collect()), key=str)


def new_endings(counts: DataFrame) -> float:
    """How often a complete sentence ends as no other does: the Good-Turing share of endings met once."""
    once = counts.where("kind in ('done', 'loose')").groupBy("kind").agg(F.sum((F.col("c") == 1).cast("int")).alias("once"), F.sum("c").alias("all"))
    return min((r.once / r["all"] for r in once.collect()), default=1.0)


def fit_endings(counts: list[tuple[str, float | None, str, int]], new: float, rounds: int = ROUNDS) -> tuple[dict[tuple[str, str], float], dict[str, float]]:
    """Log-odds of cut against complete for each (rel, ending), and of a broken transfer for each rel.

    Expectation-maximisation over the texts' kinds of length and ending.  The texts at the
    limits have their censoring posterior as prior, all others their relation's share of
    broken transfers, which is estimated along.  How cut texts end is learned from all
    relations together, since a limit or a transfer falls anywhere in a text; how complete
    texts end differs between relations.  Of the complete ones that end like sentences, the
    share ``new`` ends openly.
    """
    unmet = min(new, 0.5) / (1 - min(new, 0.5))
    rels = sorted({rel for rel, *_ in counts})
    cut = {k: c for k, (c, _) in PRIOR_ENDINGS.items()}
    complete = {(rel, k): c for rel in rels for k, (_, c) in PRIOR_ENDINGS.items()}
    share = dict.fromkeys(rels, TRANSFER)
    for _ in range(rounds):
        cuts = {k: PRIOR_TEXTS * c for k, (c, _) in PRIOR_ENDINGS.items()}
        others = {(rel, k): PRIOR_TEXTS * PRIOR_ENDINGS[k][1] for rel in rels for k in PRIOR_ENDINGS}
        lost, off = dict.fromkeys(rels, PRIOR_TEXTS * TRANSFER), dict.fromkeys(rels, PRIOR_TEXTS)
        for rel, p, k, n in counts:
            prior = share[rel] if p is None else p
            yes, no = prior * cut[k], (1 - prior) * complete[rel, k]
            post = yes / (yes + no)
            cuts[k] += n * post
            if k != "open":
                others[rel, k] += n * (1 - post)
            if k == "seen":
                others[rel, "open"] += n * (1 - post) * unmet
            if p is None:
                lost[rel] += n * post
                off[rel] += n
        total = sum(cuts.values())
        cut = {k: c / total for k, c in cuts.items()}
        sums = {rel: sum(others[rel, k] for k in PRIOR_ENDINGS) for rel in rels}
        complete = {(rel, k): c / sums[rel] for (rel, k), c in others.items()}
        last, share = share, {rel: lost[rel] / off[rel] for rel in rels}
        settled = all(abs(last[rel] - share[rel]) < 1e-9 for rel in rels)
        if settled:
            break
    evidence = {(rel, k): round(math.log(cut[k] / complete[rel, k]), 6) for rel in rels for k in PRIOR_ENDINGS}
    return evidence, {rel: round(math.log(s / (1 - s)), 6) for rel, s in share.items()}


def all_texts(events: DataFrame, claims: DataFrame) -> DataFrame:
    """(rel, key, origin, source, text) of event contents and claim texts.

    An event's origin is its agent and its source its ``source_id``; a claim's origin is
    the claim store and its source that of its first evidence.  Claims delivered twice are
    one record.
    """
    e = events.where("content is not null and content <> ''").select(
        F.lit("agent_events").alias("rel"), F.col("id").cast("string").alias("key"), F.col("agent").alias("origin"), F.col("source_id").alias("source"), F.col("content").alias("text")
    )
    c = claims.where("id is not null and text is not null and text <> ''").groupBy("id", "text").agg(F.min(F.try_element_at("evidence", F.lit(1))["source_id"]).alias("source"))
    return e.unionByName(c.select(F.lit("vault_claims").alias("rel"), F.col("id").alias("key"), F.lit("claims").alias("origin"), "source", "text"))


def cut_records(events: DataFrame, claims: DataFrame) -> DataFrame:
    """(rel, row_key): the records whose text was cut.

    Null, empty and blank texts are not cut.  Rows without a key give none.  Event rows of
    one id, and claims of one id, are one record.
    """
    return decide(all_texts(events, claims)).where("score > 0 and key is not null").select("rel", F.col("key").alias("row_key")).distinct()


def rates(events: DataFrame, claims: DataFrame, by: str = "origin") -> DataFrame:
    """(rel, origin or source, records, cut, share): how often each origin or source cuts."""
    texts = all_texts(events, claims).select("rel", "key", by).where("key is not null").groupBy("rel", "key").agg(F.min(by).alias(by))
    cut = cut_records(events, claims).withColumnRenamed("row_key", "key").withColumn("cut", F.lit(1))
    per = texts.join(cut, ["rel", "key"], "left").groupBy("rel", by).agg(F.count("*").alias("records"), F.count("cut").alias("cut"))
    return per.withColumn("share", F.round(F.col("cut") / F.col("records"), 6))


def censored(events: DataFrame, claims: DataFrame) -> DataFrame:
    """(rel, origin, limit, posterior, records, cut): what the censored fit says of each candidate limit.

    ``records`` counts the texts of that length that no punctuation closes, ``cut`` those of
    them whose posterior with the ending's evidence is above one half.
    """
    at = decide(all_texts(events, claims)).where("posterior is not null")
    out = at.groupBy("rel", "origin", F.col("n").alias("limit")).agg(F.first("posterior").alias("posterior"), F.count("*").alias("records"), F.sum((F.col("score") > 0).cast("bigint")).alias("cut"))
    return out.withColumn("posterior", F.round("posterior", 6))
