"""Text normalisation and tokenisation as column expressions (all inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions import lexicon as L

CJK = "一-鿿"
FIRST_CJK = "一"
TOKEN = f"[{CJK}]|[a-zA-Z0-9_.-]+"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.

    A column used several times in an expression is computed as often, at least inside
    higher-order functions; a lambda's variable is not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def is_cjk(token: Column) -> Column:
    """For tokens of ``TOKEN`` only: Latin ones sort before every CJK character."""
    return token >= FIRST_CJK


def _adjacent(tokens: Column) -> Column:
    """Pairs of neighbours; ``tokens`` should be a variable, see ``let``."""
    n = F.size(tokens)
    return F.when(n > 1, F.arrays_zip(F.slice(tokens, 1, n - 1).alias("a"), F.slice(tokens, 2, n - 1).alias("b"))).otherwise(
        F.array().cast("array<struct<a:string,b:string>>")
    )


def _with_pairs(raw: Column) -> Column:
    pairs = let(F.filter(raw, is_cjk), lambda cjk: F.transform(_adjacent(cjk), lambda p: F.concat(p["a"], p["b"])))
    return F.concat(raw, pairs)


def _with_mixed(raw: Column) -> Column:
    mixed = F.filter(_adjacent(raw), lambda p: is_cjk(p["a"]) != is_cjk(p["b"]))
    return F.concat(_with_pairs(raw), F.transform(mixed, lambda p: F.concat(p["a"], p["b"])))


def rerank_tokens(text: Column) -> Column:
    """Characters and Latin words in order, then pairs of CJK characters, which bridge
    what stands between them."""
    return let(all_matches(F.lower(text), TOKEN), _with_pairs)


def bm25_tokens(text: Column) -> Column:
    """T2 with the concatenations of adjacent CJK and Latin tokens."""
    return let(all_matches(F.lower(text), TOKEN), _with_mixed)


def query_terms(text: Column) -> Column:
    """Distinct runs of CJK or Latin; CJK runs of two or more also in characters and pairs."""

    def parts(run: Column) -> Column:
        n = F.length(run)
        singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(is_cjk(run) & (n >= 2), F.concat(singles, pairs)).otherwise(F.array().cast("array<string>"))

    return let(all_matches(F.lower(text), f"[{CJK}]+|[a-zA-Z0-9_.-]+"), lambda runs: F.array_distinct(F.concat(runs, F.flatten(F.transform(runs, parts)))))


def jaccard_tokens(text: Column) -> Column:
    """T4: distinct CJK characters and words."""
    return F.array_distinct(all_matches(F.lower(text), f"[{CJK}]|[a-zA-Z0-9_]+"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))  # of distinct tokens
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(0.0))


def distinct_ignoring_case(tokens: Column) -> Column:
    """Tokens without later repeats, whatever their case; order kept."""
    return let(tokens, lambda ts: let(F.transform(ts, F.lower), lambda lows: F.filter(ts, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1)))


def exact_terms(query: Column) -> Column:
    """Identifiers, ids, numbers, escaped marks and CJK chunks of three or four characters."""
    found = [all_matches(query, p) for p in (L.SNAKE, L.DOTTED, L.PREFIXED, L.HEX, L.NUMBER_UNIT, L.BIG_NUMBER, L.SPECIALS)]
    chunks = F.filter(all_matches(query, f"[{CJK}]{{2,4}}"), lambda t: F.length(t) >= 3)
    return F.filter(distinct_ignoring_case(F.concat(*found, chunks)), lambda t: F.length(t) >= 2)


def keyword_query(query: Column) -> Column:
    """Without stop words; CJK characters between stop characters glued, particles cut."""
    cut = F.regexp_replace(query, f"[{L.QUERY_STOP_CN}]", " ")
    parts = all_matches(cut, f"[{CJK}]+|[a-zA-Z0-9_.-]+")
    parts = F.transform(parts, lambda t: F.regexp_replace(t, f"[{L.QUERY_PARTICLES}]+$", ""))
    stop = F.array(*(F.lit(w) for w in L.QUERY_STOP_EN))
    return F.array_join(F.filter(parts, lambda t: (t != "") & ~F.array_contains(stop, F.lower(t))), " ")


def _entity_terms(query: Column) -> Column:
    return F.concat(*(all_matches(query, p) for p in (L.SNAKE, L.PREFIXED_QUERY, rf"\b{L.HEX}\b", L.NUMBER_UNIT_QUERY)))


def entity_query(query: Column) -> Column:
    """The query's technical identifiers, joined."""
    return F.array_join(distinct_ignoring_case(_entity_terms(query)), " ")


def rerank_entities(query: Column) -> Column:
    """T10's terms and CJK runs of three or more characters."""
    return distinct_ignoring_case(F.concat(_entity_terms(query), all_matches(query, f"[{CJK}]{{3,}}")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_of(text: Column) -> Column:
    """The first line of more than three characters, without its marks."""
    lines = F.transform(F.split(strip(text), "\n"), lambda x: strip(F.regexp_replace(strip(x), "^#+", "")))
    return F.coalesce(F.substring(F.try_element_at(F.filter(lines, lambda x: F.length(x) > 3), F.lit(1)), 1, 80), F.lit("Untitled"))


#: Ordered substitutions of the markdown cleaner (fixed values); lines end with \\n only.
MARKDOWN = (
    (r"(?s)```[\w]*\n(.*?)```", "$1"), (r"`([^`]+)`", "$1"), (r"(?d)\*\*(.+?)\*\*", "$1"), (r"(?d)__(.+?)__", "$1"), (r"(?dU)(?<!\w)\*(.+?)\*(?!\w)", "$1"), (r"(?d)~~(.+?)~~", "$1"),
    (r"(?dm)^#{1,6}\s+", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"<[^>]+>", ""), (r"(?dm)^[-*_]{3,}\s*$", ""), (r"(?dm)^>\s?", ""),
    (r"(?dm)^\|[-:| ]+\|\s*$", ""), (r"(?dm)^\||\|$", ""),
)


def clean_markdown(text: Column) -> Column:
    """T5: plain text of markdown."""
    for pattern, new in MARKDOWN:
        text = F.regexp_replace(text, pattern, new)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return strip(F.array_join(F.transform(F.split(text, "\n"), strip), "\n"))


def identifiers(text: Column) -> Column:
    """Identifiers in backticks, in snake case and with known prefixes."""
    ticked = F.filter(F.transform(all_matches(text, "`([^`]+)`", 1), strip), lambda t: (t != "") & (F.length(t) < 100))
    return distinct_ignoring_case(F.concat(ticked, all_matches(text, rf"(?U)\b({L.SNAKE})\b", 1), all_matches(text, rf"(?U)\b({L.PREFIXED})\b", 1)))


def clean_for_index(text: Column) -> Column:
    """Plain text with the identifiers on a line of their own."""
    return F.concat(clean_markdown(text), let(identifiers(text), lambda ids: F.when(F.size(ids) > 0, F.concat(F.lit("\n"), F.array_join(ids, " "))).otherwise("")))


def _cut_out(text: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` (from 0) up to ``end``, on one line, with marks where cut."""
    body = strip(F.replace(F.substring(text, start + 1, end - start), F.lit("\n"), F.lit(" ")))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))


def bm25_snippet(text: Column, tokens: Column) -> Column:
    """200 characters from 50 before the earliest token."""
    low, n = F.lower(text), F.length(text)
    hits = F.filter(F.transform(tokens, lambda t: F.instr(low, t)), lambda p: p > 0)
    first = F.coalesce(F.array_min(hits) - 1, n)
    start = F.greatest(F.lit(0), first - 50)
    return _cut_out(text, start, F.least(n, start + 200))


def exact_snippet(text: Column, term: Column) -> Column:
    """From 80 before to 120 after the term."""
    n, at = F.length(text), F.instr(F.lower(text), F.lower(term)) - 1
    start = F.greatest(F.lit(0), at - 80)
    plain = strip(F.replace(F.substring(text, 1, 200), F.lit("\n"), F.lit(" ")))
    return F.when(at >= 0, _cut_out(text, start, F.least(n, at + F.length(term) + 120))).otherwise(plain)


def incidental_facts(text: Column) -> Column:
    """Facts that a speaker mentions in passing."""
    low, high = L.FACT_CHARS
    found = F.concat(*(all_matches(text, "(?i)" + p) for p in L.INCIDENTAL))
    facts = F.transform(found, lambda t: F.regexp_replace(strip(t), "[,;:]+$", ""))
    return distinct_ignoring_case(F.filter(facts, lambda t: (F.length(t) >= low) & (F.length(t) <= high)))


def space_scripts(text: Column) -> Column:
    """No blanks between CJK and Latin."""
    return F.regexp_replace(F.regexp_replace(text, f"([{CJK}])\\s+([a-zA-Z0-9])", "$1$2"), f"([a-zA-Z0-9])\\s+([{CJK}])", "$1$2")


# --- signals ----------------------------------------------------------------------------


def signal(text: Column, alternation: str) -> Column:
    return text.rlike("(?i)(?:" + alternation + ")")


def durability(text: Column, tag: Column) -> Column:
    """X4."""
    return (
        F.when(tag == "decision", "stable").when(tag == "todo", "temporary").when(signal(text, L.TEMPORARY), "temporary").otherwise("unknown")
    )


def polarity(text: Column) -> Column:
    """Which side of the opposites has more words in the text."""
    low = F.lower(text)
    balance = sum((low.contains(p).cast("int") - low.contains(n).cast("int") for p, n in L.OPPOSITES), F.lit(0))
    return F.when(balance > 0, "positive").when(balance < 0, "negative").otherwise("neutral")


def confidence(weights: Column) -> Column:
    """X6, of an array of evidence weights."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return F.when(F.size(weights) > 0, F.least(F.lit(0.95), total / (total + 1))).otherwise(F.lit(0.0))


def foresight_days(text: Column) -> Column:
    """Days until a forward-looking text falls due; null for others."""
    days = F.lit(L.FORESIGHT_DEFAULT_DAYS)
    for pattern, n in reversed(L.FORESIGHT_DAYS):
        days = F.when(signal(text, pattern), n).otherwise(days)
    return F.when(signal(text, L.FORESIGHT), days)


def suffix_type(name: Column) -> Column:
    """X13."""
    kind = F.lit("named")
    for t, pattern in reversed(L.SUFFIXES):
        kind = F.when(name.rlike(pattern), t).otherwise(kind)
    return kind
