"""The driver's queries of the core, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T
from recollect.operators import claims as C
from recollect.operators import dream, entities, evaluate, events, graph, hooks, leader, rerank, retrieval, truth, umsf
from recollect.plans import corpus, engine
from recollect.session import cut_lineage
from recollect.sources import pull
from recollect.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
AS_OF = corpus.AS_OF
K = 10


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- SQL building blocks ----------------------------------------------------------------


def _tokens(text: str) -> str:
    """T1 in SQL."""
    raw = rf"regexp_extract_all(lower({text}), '[\x{{4e00}}-\x{{9fff}}]|[a-zA-Z0-9_.-]+')"
    cjk = f"list_filter({raw}, lambda z: z >= '一')"
    pairs = lambda x: f"list_zip({x}[:-2], {x}[2:])"
    two = f"list_transform({pairs(cjk)}, lambda p: p[1] || p[2])"
    mixed = f"list_transform(list_filter({pairs(raw)}, lambda p: (p[1] >= '一') <> (p[2] >= '一')), lambda p: p[1] || p[2])"
    return f"list_concat(list_concat({raw}, {two}), {mixed})"


def _set(text: str) -> str:
    """T4 in SQL."""
    return rf"list_distinct(regexp_extract_all(lower({text}), '[\x{{4e00}}-\x{{9fff}}]|[a-zA-Z0-9_]+'))"


def _signal(text: str, alternation: str) -> str:
    return f"regexp_matches({text}, '(?i)(?:{alternation.replace(chr(39), chr(39) * 2)})')"


def _case(pairs: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def _polarity(text: str) -> str:
    balance = " + ".join(f"(contains(lower({text}), '{p}'))::int - (contains(lower({text}), '{n}'))::int" for p, n in L.OPPOSITES)
    return f"CASE WHEN {balance} > 0 THEN 'positive' WHEN {balance} < 0 THEN 'negative' ELSE 'neutral' END"


_WS = r"^[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{_WS}', '', 'g')"


_SOURCES = """s AS (
  SELECT id, r.title AS title, r.content AS content, r.source_type AS source_type, r.ingested_at AS ingested_at FROM (
    SELECT id, min({'ingested_at': ingested_at, 'title': title, 'content': content, 'source_type': source_type, 'path': path}) AS r
    FROM vault_sources WHERE id IS NOT NULL GROUP BY id))"""
_CLAIMS = """c AS (
  SELECT id AS claim_id, any_value(entity_id) AS entity_id, any_value(text) AS text, any_value(tags) AS tags, any_value(status) AS status, any_value(polarity) AS polarity,
    any_value(durability) AS durability, any_value(confidence) AS confidence, any_value(created_at) AS created_at, any_value(evidence) AS evidence
  FROM vault_claims WHERE id IS NOT NULL GROUP BY id)"""
_DOC_QUERIES = r"""q AS (
  SELECT doc_id AS query_id, array_to_string(regexp_extract_all(text, '\S+')[1:12], ' ') AS query FROM documents WHERE text IS NOT NULL AND doc_id % 50 = 0),
  qq AS (SELECT * FROM q WHERE query <> '')"""
_BM25 = f"""{_DOC_QUERIES},
  d AS (SELECT doc_id, text, {_tokens("text")} AS toks FROM documents WHERE text IS NOT NULL),
  st AS (SELECT count(*) AS n, avg(len(toks)) AS avg_dl FROM d),
  p AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d) GROUP BY 1, 2),
  df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens("query")}) AS term FROM qq) GROUP BY 1, 2),
  sc AS (
    SELECT query_id, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))) AS s
    FROM qt JOIN df USING (term) JOIN p USING (term), st GROUP BY 1, 2),
  bo AS (
    SELECT query_id, doc_id, round(s * CASE WHEN contains(lower(text), lower(query)) THEN CASE WHEN length(query) >= 6 THEN 1.5 * 1.3 ELSE 1.5 END ELSE 1 END, 4) AS score
    FROM sc JOIN qq USING (query_id) JOIN d USING (doc_id) WHERE s > 0),
  bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bo)"""


def _sections(column: str, pick: int, other: str) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + column + " " + " ".join(f"WHEN '{name}' THEN {text(found[pick])}" for name, found in L.SECTIONS.items()) + f" ELSE {other} END"


_SPACE = _WS[2 : _WS.index("]+|")]
#: X1, X3 in SQL, from a relation ``s`` of (id, content).
_EXTRACT = rf"""l0 AS (SELECT id, unnest(range(1, len(p) + 1)) AS pos, unnest(p) AS line FROM (SELECT id, string_split({_strip("content")}, chr(10)) AS p FROM s WHERE content IS NOT NULL)),
  l1 AS (SELECT id, pos, {_strip("line")} AS line FROM l0),
  l2 AS (SELECT *, starts_with(line, '##') AS head FROM l1),
  l3 AS (SELECT id, pos, line, head, coalesce(last_value(CASE WHEN head THEN lower({_strip("regexp_replace(line, '^#+', '')")}) END IGNORE NULLS) OVER w, '') AS section, sum(head::int) OVER w AS block
    FROM l2 WINDOW w AS (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  ls AS (SELECT *, starts_with(line, '- ') AND length(line) > 10 AS item FROM l3 WHERE NOT head AND line <> '' AND NOT starts_with(line, '#')),
  a AS (SELECT id, block, 0 AS part, pos AS n, {_strip("line[3:]")} AS text, 'list' AS kind, section, {_sections("section", 0, "0.4")} AS weight, {_sections("section", 1, "NULL")} AS tag FROM ls WHERE item),
  b0 AS (SELECT id, block, section, string_split(regexp_replace(string_agg(line, ' ' ORDER BY pos), '([.!?。！？])[{_SPACE}]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM ls WHERE NOT item AND length(line) > 20 GROUP BY 1, 2, 3),
  b1 AS (SELECT id, block, section, unnest(range(1, len(p) + 1)) AS n, {_strip("unnest(p)")} AS t FROM b0),
  b2 AS (SELECT *, CASE WHEN {_signal("t", L.DECISION)} THEN 'decision' WHEN {_signal("t", L.FACT)} THEN 'fact' WHEN {_signal("t", L.RISK)} THEN 'risk' END AS sign, {_sections("section", 0, "0.4")} AS sw FROM b1 WHERE length(t) >= 15),
  b AS (SELECT id, block, 1 AS part, n, t[:500] AS text, 'prose' AS kind, section, CASE sign WHEN 'decision' THEN 1.0 WHEN 'fact' THEN 0.7 WHEN 'risk' THEN 0.7 ELSE sw END AS weight, coalesce(sign, {_sections("section", 1, "NULL")}) AS tag
    FROM b2 WHERE sign IS NOT NULL OR sw >= 0.7),
  x AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY block, part, n)::INT AS ordinal, text, kind, section, weight::DOUBLE AS weight, tag,
    CASE WHEN coalesce(tag, '') = 'decision' THEN 'stable' WHEN coalesce(tag, '') = 'todo' THEN 'temporary' WHEN {_signal("text", L.TEMPORARY)} THEN 'temporary' ELSE 'unknown' END AS durability,
    {_polarity("text")} AS polarity, round(least(0.95, weight::DOUBLE / (weight::DOUBLE + 1)), 3) AS confidence FROM (SELECT * FROM a UNION ALL SELECT * FROM b))"""



def _greedy(name: str, threshold: float, also: str = "true") -> str:
    """K6, K8, D3 in SQL, item by item: ``name`` is (id, grp, toks, i), i counting from 1 within a group in
    order, with whatever ``also`` compares of a and b.  Gives ``name``_led (id, grp, leader)."""
    both = "len(list_intersect(a.toks, b.toks))"
    alike = f"len(a.toks) > 0 AND len(b.toks) > 0 AND {both}::DOUBLE / (len(a.toks) + len(b.toks) - {both}) >= {threshold} - 1e-12"
    return f"""{name}_nb AS (SELECT b.grp, b.i, b.id, coalesce(list(a.id ORDER BY a.i) FILTER (a.id IS NOT NULL), []) AS nb FROM {name} b LEFT JOIN {name} a ON a.grp = b.grp AND a.i < b.i AND {alike} AND ({also}) GROUP BY 1, 2, 3),
  {name}_st AS (SELECT DISTINCT grp, 0::BIGINT AS i, id[:0] AS leaders FROM (SELECT grp, [id] AS id FROM {name})
    UNION ALL SELECT s.grp, n.i, CASE WHEN list_has_any(n.nb, s.leaders) THEN s.leaders ELSE list_append(s.leaders, n.id) END FROM {name}_st s JOIN {name}_nb n ON n.grp = s.grp AND n.i = s.i + 1),
  {name}_led AS (SELECT n.id, n.grp, coalesce(list_filter(n.nb, lambda x: list_contains(f.leaders, x))[1], n.id) AS leader FROM {name}_nb n JOIN (SELECT grp, arg_max(leaders, i) AS leaders FROM {name}_st GROUP BY 1) f USING (grp))"""


def _first_of(items: str, low: str = "lower(x)") -> str:
    """A list without later repeats, order kept."""
    return f"list_filter({items}, lambda x, i: list_position(list_transform({items}, lambda y: {low.replace('x', 'y')}), {low}) = i)"


def _joined(*lists: str) -> str:
    out = lists[0]
    for other in lists[1:]:
        out = f"list_concat({out}, {other})"
    return out


_CJK = r"\x{4e00}-\x{9fff}"


def _found(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


def _runs(text: str, pattern: str) -> str:
    """Matches between word boundaries of a pattern of word characters: whole runs of them."""
    return rf"list_filter(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '{pattern}'))"


def _exact_terms(q: str) -> str:
    """T8 in SQL."""
    plain = [_found(q, p) for p in (L.SNAKE, L.DOTTED, L.PREFIXED, L.HEX, L.NUMBER_UNIT)]
    found = _joined(*plain, _runs(q, r"\d{3,}"), _found(q, L.SPECIALS), f"list_filter({_found(q, f'[{_CJK}]{{2,4}}')}, lambda t: length(t) >= 3)")
    return f"list_filter({_first_of(found)}, lambda t: length(t) >= 2)"


def _entity_terms(q: str) -> str:
    return _joined(_found(q, L.SNAKE), _found(q, L.PREFIXED_QUERY), _runs(q, L.HEX), _found(q, L.NUMBER_UNIT_QUERY))


def _query_terms(q: str) -> str:
    """T3 in SQL."""
    runs = _found(f"lower({q})", f"[{_CJK}]+|[a-zA-Z0-9_.-]+")
    parts = "CASE WHEN r >= '一' AND length(r) >= 2 THEN list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) ELSE [] END"
    return _first_of(f"list_concat({runs}, flatten(list_transform({runs}, lambda r: {parts})))", "x")



_WORDY = r"\p{L}\p{N}\p{M}_"
#: A text in which no word boundary stands between ASCII and other letters, as the SQL engine sees them.
_OTHER = r"[\x{aa}\x{b5}\x{ba}\x{c0}-\x{2af}\x{300}-\x{1fff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}]"
_BOUND = rf"regexp_replace(regexp_replace(content, '([A-Za-z0-9_])({_OTHER})', '\1_\2', 'g'), '({_OTHER})([A-Za-z0-9_])', '\1_\2', 'g')"


def _between(text: str, pattern: str) -> str:
    """Matches of a pattern of any letters between word boundaries."""
    return rf"regexp_extract_all({text}, '(?i)(?:^|[^{_WORDY}])({pattern})(?:$|[^{_WORDY}])', 1)"


def _typed_matches() -> list[tuple[int, str, str]]:
    """(rank, type, SQL list of names) of X8."""
    email = rf"regexp_extract_all(content, '([{_WORDY}][{_WORDY}.+-]*@[{_WORDY}-]+\.[{_WORDY}.-]*[{_WORDY}])', 1)"
    out = []
    for i, (kind, patterns) in enumerate(L.TYPED):
        for j, p in enumerate(patterns):
            if "@" in p:
                sql = email
            elif "财年" in p or "美元" in p or "策略" in p:
                inner = p.removeprefix("(?i)").removeprefix(r"\b(").removesuffix(r"\b").removesuffix(")")
                sql = _between("content", inner) if p.endswith(r"\b") else rf"regexp_extract_all(content, '(?i)(?:^|[^{_WORDY}])({inner})', 1)"
            elif r"\b" in p:
                sql = f"regexp_extract_all(bound, '{p}', 1)"
            elif p.startswith("(?<![A-Za-z])"):
                sql = f"regexp_extract_all(content, '(?:^|[^A-Za-z]){p.removeprefix('(?<![A-Za-z])')}', 1)"
            else:
                sql = f"regexp_extract_all(content, '{p}', 1)"
            out.append((i * 100 + j, kind, sql))
    return out


def _suffix(name: str) -> str:
    return _case([(f"regexp_matches({name}, '{p}')", f"'{t}'") for t, p in L.SUFFIXES], "'named'")


_TYPED = f"""{_SOURCES}, tx AS (SELECT id, content, {_BOUND} AS bound FROM s WHERE content IS NOT NULL),
  th AS (SELECT id, rank, type, {_strip("name")} AS name FROM ({" UNION ALL ".join(f"SELECT id, {r} AS rank, '{t}' AS type, unnest({q}) AS name FROM tx" for r, t, q in _typed_matches())})),
  t1 AS (SELECT id, name, arg_min(type, rank) AS type FROM th WHERE length(name) >= 2 GROUP BY 1, 2),
  ty AS (SELECT * FROM t1 a WHERE NOT EXISTS (SELECT 1 FROM t1 b WHERE b.id = a.id AND b.type = a.type AND length(b.name) > length(a.name) AND contains(b.name, a.name)))"""


def _candidates_sql() -> str:
    """X11, X12 and F5 in SQL: (id, name) of noun-like strings."""
    stop = sorted(L.name_stop_cn())
    many = "|".join(sorted((w for w in stop if len(w) > 1), key=len, reverse=True))
    every = "|".join(sorted(stop, key=len, reverse=True))
    full = lambda run, p: f"list_filter(regexp_extract_all(content, '{run}'), lambda w: regexp_full_match(w, '{p}'))"
    latin = [
        full("[A-Za-z]+", "[A-Z][a-z]+(?:[A-Z][a-z]+)+"),
        "list_filter(list_transform(regexp_extract_all(content, '[A-Za-z]+'), lambda w: regexp_extract(w, '^([A-Z][a-z]+[A-Z]{2,5})(?:[A-Z].*)?$', 1)), lambda w: w <> '')",
        full("[A-Za-z]+", "[A-Z]{2,8}"),
        full("[A-Za-z0-9_-]+", "[a-z][a-z0-9]*(?:[_-][a-z0-9]+){1,5}"),
        "regexp_extract_all(bound, '" + L.CANDIDATES[4] + "', 1)",
        *(f"regexp_extract_all(content, '{p}', 1)" for p in L.CANDIDATES[5:]),
    ]
    cut = f"regexp_extract_all(regexp_replace(content, '(?:{many}|[{L.PARTICLES}])', chr(1), 'g'), '[{_CJK}]{{2,}}')"
    chunk = f"CASE WHEN length(c) <= 4 OR {_suffix('c')} <> 'named' THEN [c] ELSE [c[:4], c[-4:]] END"
    names = " UNION ALL ".join(f"SELECT id, regexp_replace({_strip('unnest(' + q + ')')}, '^(?:The|A|An) ', '') AS name FROM tx" for q in latin)
    no = (
        f"length(name) < 2 OR regexp_matches(regexp_replace(name, '[,. ]', '', 'g'), '^[0-9]+$') OR list_contains({stop!r}, name) OR (regexp_matches(name, '^[A-Z][a-z]*$') AND list_contains({list(L.NAME_STOP_EN)!r}, lower(name)))"
        f" OR (regexp_matches(name, '^[{_CJK}]+$') AND regexp_matches(name, '^[{L.FRAGMENT_STARTERS}]|^(?:{many})*(?:{every})$'))"
    )
    return f"SELECT DISTINCT id, name FROM ({names} UNION ALL SELECT id, unnest(flatten(list_transform({cut}, lambda c: {chunk}))) FROM tx) WHERE NOT ({no})"



def _facts_of(text: str) -> str:
    """T16 in SQL, with repeats."""
    found = _joined(*(f"regexp_extract_all({text}, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in L.INCIDENTAL))
    return f"list_filter(list_transform({found}, lambda t: regexp_replace({_strip('t')}, '[,;:]+$', '')), lambda t: length(t) >= {L.FACT_CHARS[0]} AND length(t) <= {L.FACT_CHARS[1]})"


_SUMMARY = f"""su_a AS (SELECT *, coalesce(tags[1], 'other') AS tag FROM c WHERE status = 'active' AND entity_id IS NOT NULL AND text IS NOT NULL),
  su_r AS (SELECT *, list_position({list(L.SUMMARY_ORDER)}, tag) AS place, row_number() OVER (PARTITION BY entity_id, tag ORDER BY confidence DESC NULLS LAST, created_at, claim_id) AS n FROM su_a),
  su_p AS (SELECT entity_id, place, '[' || ({list(L.SUMMARY_LABELS)})[place] || '] ' || string_agg(text[:120], '; ' ORDER BY n) AS p FROM su_r WHERE place > 0 AND n <= 3 GROUP BY 1, 2),
  su_j AS (SELECT entity_id, string_agg(p, ' | ' ORDER BY place) AS summary FROM su_p GROUP BY 1), su_f AS (SELECT entity_id, arg_min(text[:200], (created_at, claim_id)) AS first FROM su_a GROUP BY 1),
  su AS (SELECT entity_id, coalesce(summary, first) AS summary FROM su_f LEFT JOIN su_j USING (entity_id))"""

# --- text -------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({_tokens('text')}) AS n_tokens, {_tokens('text')} AS tokens FROM documents WHERE text IS NOT NULL")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    """T1."""
    tokens = T.bm25_tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(tokens).alias("n_tokens"), tokens.alias("tokens"))


@query(f"SELECT doc_id, len({_set('text')}) AS n, list_sort({_set('text')}) AS words FROM documents WHERE text IS NOT NULL")
def token_sets(spark: SparkSession, d: str) -> DataFrame:
    """T4."""
    words = T.jaccard_tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(words).alias("n"), F.array_sort(words).alias("words"))


@query(
    f"""SELECT doc_id, coalesce(list_filter(list_transform(string_split({_strip("text")}, chr(10)), lambda x: {_strip(f"regexp_replace({_strip('x')}, '^#+', '')")}), lambda x: length(x) > 3)[1][:80], 'Untitled') AS title
    FROM documents WHERE text IS NOT NULL"""
)
def title_derive(spark: SparkSession, d: str) -> DataFrame:
    """T13."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.title_of(F.col("text")).alias("title"))


def _clean(text: str) -> str:
    """T5 in SQL."""
    for pattern, new in T.MARKDOWN:
        p, new = pattern.replace("(?dU)", "").replace("(?dm)", "(?m)").replace("(?d)", "").replace("'", "''"), new.replace("$1", r"\1")
        if "(?<!" in p:  # emphasis between characters that are no letters; twice, since neighbours share such a character
            for _ in range(2):
                text = rf"regexp_replace({text}, '(^|[^{_WORDY}])\*(.+?)\*($|[^{_WORDY}])', '\1\2\3', 'g')"
        else:
            text = f"regexp_replace({text}, '{p}', '{new}', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(f"array_to_string(list_transform(string_split({text}, chr(10)), lambda x: {_strip('x')}), chr(10))")


@query(
    rf"""WITH t AS (SELECT doc_id, text AS content FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, content, {_BOUND} AS bound FROM t),
    v AS (SELECT doc_id, content, list_concat(list_concat(list_filter(list_transform(regexp_extract_all(content, '`([^`]+)`', 1), lambda t: {_strip("t")}), lambda t: t <> '' AND length(t) < 100), regexp_extract_all(bound, '\b({L.SNAKE})\b', 1)), regexp_extract_all(bound, '\b({L.PREFIXED})\b', 1)) AS ids FROM u)
    SELECT doc_id, {_clean("content")} AS plain, {_first_of("ids")} AS identifiers FROM v"""
)
def clean_markdown(spark: SparkSession, d: str) -> DataFrame:
    """T5 to T7."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.clean_markdown(F.col("text")).alias("plain"), T.identifiers(F.col("text")).alias("identifiers"))


@query(
    f"""WITH qq AS (SELECT doc_id AS query_id, {_strip("text")} AS query FROM documents WHERE text IS NOT NULL), t AS (
      SELECT query_id, query, regexp_extract_all(regexp_replace(query, '[{L.QUERY_STOP_CN}]', ' ', 'g'), '[\\x{{4e00}}-\\x{{9fff}}]+|[a-zA-Z0-9_.-]+') AS parts FROM qq),
      k AS (SELECT query_id, query, list_transform(parts, lambda t: regexp_replace(t, '[{L.QUERY_PARTICLES}]+$', '')) AS parts FROM t)
    SELECT query_id, query AS original, array_to_string(list_filter(parts, lambda t: t <> '' AND NOT list_contains([{", ".join(repr(w) for w in L.QUERY_STOP_EN)}], lower(t))), ' ') AS keyword FROM k"""
)
def query_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """T9, T12 of every document's whole text."""
    return engine.rewrite(corpus.whole_texts(spark, d)).select("query_id", "original", "keyword")


@query(
    f"""WITH q AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE text IS NOT NULL)
    SELECT query_id, {_exact_terms("query")} AS exact, array_to_string({_first_of(_entity_terms("query"))}, ' ') AS entity, {_first_of(_joined(_entity_terms("query"), _found("query", f"[{_CJK}]{{3,}}")))} AS key_terms,
      {_query_terms("query")} AS terms FROM q"""
)
def query_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """T8, T10, T11 of every document's whole text."""
    q = F.col("query")
    return corpus.whole_texts(spark, d).select("query_id", T.exact_terms(q).alias("exact"), T.entity_query(q).alias("entity"), T.rerank_entities(q).alias("key_terms"), T.query_terms(q).alias("terms"))


@query(
    f"""WITH g AS (SELECT doc_id, {_facts_of("text")} AS fs FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, generate_subscripts(fs, 1)::INT - 1 AS pos, unnest(fs) AS fact FROM (SELECT doc_id, {_first_of("fs")} AS fs FROM g)"""
)
def fact_extract(spark: SparkSession, d: str) -> DataFrame:
    """T16."""
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", F.posexplode(T.incidental_facts(F.col("text"))).alias("pos", "fact"))


# --- retrieval --------------------------------------------------------------------------


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= {K}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """R2, R3, R12."""
    return retrieval.bm25(corpus.documents_index(spark, d), corpus.document_queries(spark, d), K)


_EXACT = f"""{_DOC_QUERIES}, x AS (SELECT query_id, generate_subscripts(ts, 1) AS n, lower(unnest(ts)) AS low FROM (SELECT query_id, {_exact_terms("query")} AS ts FROM qq)),
  b AS (SELECT doc_id, lower(text) AS body FROM documents WHERE text IS NOT NULL), l AS (SELECT DISTINCT low FROM x),
  f AS (SELECT low, doc_id, (length(body) - length(replace(body, low, ''))) // length(low) AS c, instr(body, low) - 1 AS pos FROM l JOIN b ON contains(body, low)),
  g AS (SELECT query_id, doc_id, round(sum((c * 2.0 + 1.0 / (1.0 + pos / 1000.0)) * (1.0 + length(low) / 20.0)) * (1.0 + 0.3 * (count(*) - 1)), 4) AS score FROM x JOIN f USING (low) GROUP BY 1, 2),
  ex AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g)"""


@query(f"WITH {_EXACT} SELECT * FROM ex WHERE rank <= {K}")
def exact_topk(spark: SparkSession, d: str) -> DataFrame:
    """R4."""
    docs = corpus.documents(spark, d).select("doc_id", "text")
    return retrieval.exact(docs, corpus.document_queries(spark, d), K).select("query_id", "doc_id", "score", "rank")


@query(
    f"""WITH {_BM25}, l AS (SELECT query_id, doc_id, 2.0 / (60 + rank) AS s FROM bm WHERE rank <= 30
      UNION ALL SELECT query_id, query_id, 1.0 / 61 FROM qq),
    f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM l GROUP BY 1, 2)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= {K}"""
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """BM25 with a list of known items."""
    q = corpus.document_queries(spark, d)
    known = q.select("query_id", F.col("query_id").alias("doc_id"), F.lit(1).alias("rank"))
    return retrieval.rrf([(retrieval.bm25(corpus.documents_index(spark, d), q, 30), 2.0), (known, 1.0)], K)


@query(
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(round(list_cosine_similarity(a.v, b.v), 10), 4) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {K}"""
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """R5."""
    v = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = v.where(corpus.is_query(F.col("doc_id"))).select(F.col("doc_id").alias("query_id"), "vector")
    return retrieval.vector_search(v, q, K, exclude_self=True)


@query()
def vector_near(spark: SparkSession, d: str) -> DataFrame:
    """R5 by the approximate index, which is fitted on a sample and holds every row."""
    v = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = v.where(corpus.is_query(F.col("doc_id"))).select(F.col("doc_id").alias("query_id"), "vector")
    index = corpus.stored(spark, d, ("embeddings",), "vectors", lambda: retrieval.vector_index(v))
    return retrieval.vector_search_near(index, q, K, exclude_self=True)


_EDGES = """cnt AS (SELECT l_partkey AS entity_id, l_orderkey AS source_id, count(*) AS c FROM lineitem GROUP BY 1, 2),
  e AS (SELECT entity_id, source_id, c / (SELECT max(c) FROM cnt) AS ew FROM cnt),
  r AS (SELECT p_partkey AS query_id, p_partkey AS entity_id FROM part WHERE p_partkey % 50 = 0),
  h1 AS (SELECT query_id, source_id, sum(ew) AS score FROM r JOIN e USING (entity_id) GROUP BY 1, 2)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("source_id"))
    roots = table(spark, d, "part").where(corpus.is_query(F.col("p_partkey"))).select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("entity_id"))
    return roots, edges


@query(
    f"""WITH {_EDGES}, x AS (SELECT query_id, source_id AS doc_id, round(score, 4) AS score FROM h1)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= {K}"""
)
def graph_1hop(spark: SparkSession, d: str) -> DataFrame:
    """R6, R7, first hop."""
    found = graph.neighbours(*_graph(spark, d), hops=1)
    return retrieval.top_k(found.select("query_id", "doc_id", F.round("score", 4).alias("score")), K)


@query(
    f"""WITH {_EDGES}, w AS (
      SELECT query_id, e.entity_id, count(*) AS ways FROM h1 JOIN e USING (source_id) WHERE e.entity_id <> query_id GROUP BY 1, 2),
    h2 AS (SELECT query_id, source_id, sum(ew * 0.5 * ways) AS score FROM w JOIN e USING (entity_id) WHERE (query_id, source_id) NOT IN (SELECT query_id, source_id FROM h1) GROUP BY 1, 2),
    x AS (SELECT query_id, source_id AS doc_id, round(score, 4) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2))
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= {K}"""
)
def graph_2hop(spark: SparkSession, d: str) -> DataFrame:
    """R7."""
    found = graph.neighbours(*_graph(spark, d), hops=2)
    return retrieval.top_k(found.select("query_id", "doc_id", F.round("score", 4).alias("score")), K)


def _ranked(scored: str, out: str) -> str:
    return f"{out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {scored})"


def _bm25_over(out: str, docs: str, queries: str) -> str:
    """R2 in SQL: ``docs`` (doc_id, text), ``queries`` (query_id, query)."""
    return f"""{out}_d AS (SELECT doc_id, text, {_tokens("text")} AS toks FROM {docs}), {out}_st AS (SELECT count(*) AS n, avg(len(toks)) AS avg_dl FROM {out}_d),
  {out}_p AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM {out}_d) GROUP BY 1, 2), {out}_df AS (SELECT term, count(*) AS df FROM {out}_p GROUP BY 1),
  {out}_qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens("query")}) AS term FROM {queries}) GROUP BY 1, 2),
  {out}_sc AS (SELECT query_id, doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))) AS s FROM {out}_qt JOIN {out}_df USING (term) JOIN {out}_p USING (term), {out}_st GROUP BY 1, 2),
  {out}_bo AS (SELECT query_id, doc_id, round(s * CASE WHEN contains(lower(text), lower(query)) THEN CASE WHEN length(query) >= 6 THEN 1.5 * 1.3 ELSE 1.5 END ELSE 1 END, 4) AS score FROM {out}_sc JOIN {queries} USING (query_id) JOIN {out}_d USING (doc_id) WHERE s > 0),
  {_ranked(out + "_bo", out)}"""


def _exact_over(out: str, docs: str, queries: str) -> str:
    """R4 in SQL, over (doc_id, raw)."""
    return f"""{out}_x AS (SELECT query_id, lower(unnest(ts)) AS low FROM (SELECT query_id, {_exact_terms("query")} AS ts FROM {queries})), {out}_b AS (SELECT doc_id, lower(raw) AS body FROM {docs}), {out}_l AS (SELECT DISTINCT low FROM {out}_x),
  {out}_f AS (SELECT low, doc_id, (length(body) - length(replace(body, low, ''))) // length(low) AS c, instr(body, low) - 1 AS pos FROM {out}_l JOIN {out}_b ON contains(body, low)),
  {out}_g AS (SELECT query_id, doc_id, round(sum((c * 2.0 + 1.0 / (1.0 + pos / 1000.0)) * (1.0 + length(low) / 20.0)) * (1.0 + 0.3 * (count(*) - 1)), 4) AS score FROM {out}_x JOIN {out}_f USING (low) GROUP BY 1, 2), {_ranked(out + "_g", out)}"""


def _identified(text: str) -> str:
    return f"""list_concat(list_concat(list_filter(list_transform(regexp_extract_all({text}, '`([^`]+)`', 1), lambda t: {_strip("t")}), lambda t: t <> '' AND length(t) < 100), regexp_extract_all(bound, '\\b({L.SNAKE})\\b', 1)), regexp_extract_all(bound, '\\b({L.PREFIXED})\\b', 1))"""


def _vault_docs(facts: bool) -> str:
    """R1 in SQL: docs (doc_id, title, text, raw, page_type)."""
    children = f""" UNION ALL SELECT id || '#fact_' || (n - 1), title, fact, fact, 'fact' FROM (SELECT id, title, generate_subscripts(fs, 1) AS n, unnest(fs) AS fact FROM (
      SELECT id, title, {_first_of("fs")} AS fs FROM (SELECT id, title, {_facts_of("content")} AS fs FROM src)))""" if facts else ""
    return f"""{_SOURCES}, {_CLAIMS}, {_SUMMARY}, src AS (SELECT id, coalesce(title, '') AS title, coalesce(content, '') AS content, {_BOUND} AS bound FROM s),
  si AS (SELECT *, {_identified("content")} AS ids FROM src), sj AS (SELECT *, {_first_of("ids")} AS one FROM si),
  ct AS (SELECT entity_id AS id, string_agg(text, chr(10) ORDER BY created_at NULLS FIRST, claim_id) AS claims FROM c WHERE status = 'active' AND entity_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
  ep AS (SELECT e.id, trim(name) AS name, trim(name) || chr(10) || coalesce(summary, '') || chr(10) || coalesce(claims, '') AS page FROM vault_entities e LEFT JOIN su ON su.entity_id = e.id LEFT JOIN ct ON ct.id = e.id WHERE e.id IS NOT NULL AND name IS NOT NULL),
  docs AS (SELECT id AS doc_id, title, {_clean("content")} || CASE WHEN len(one) > 0 THEN chr(10) || array_to_string(one, ' ') ELSE '' END AS text, content AS raw, 'source' AS page_type FROM sj
    UNION ALL SELECT id, name, page, page, 'entity' FROM ep{children})"""


def _engine(facts: bool = False) -> str:
    """R8 to R10 in SQL: pool (query_id, doc_id, score, rank) of the thirty fused first."""
    return f"""{_vault_docs(facts)}, {_DOC_QUERIES},
  rw0 AS (SELECT query_id, {_strip("query")} AS original FROM qq),
  rw AS (SELECT query_id, original, array_to_string({_first_of(_entity_terms("original"))}, ' ') AS entity, array_to_string(list_filter(list_transform(regexp_extract_all(regexp_replace(original, '[{L.QUERY_STOP_CN}]', ' ', 'g'), '[{_CJK}]+|[a-zA-Z0-9_.-]+'),
    lambda t: regexp_replace(t, '[{L.QUERY_PARTICLES}]+$', '')), lambda t: t <> '' AND NOT list_contains({list(L.QUERY_STOP_EN)!r}, lower(t))), ' ') AS keyword FROM rw0),
  q1 AS (SELECT query_id, original AS query FROM rw), q2 AS (SELECT query_id, entity AS query FROM rw WHERE entity <> '' AND entity <> original), q3 AS (SELECT query_id, keyword AS query FROM rw WHERE keyword <> '' AND keyword <> original),
  {_exact_over("ex1", "docs", "q1")}, {_exact_over("ex2", "docs", "q2")}, {_bm25_over("bm1", "docs", "q1")}, {_bm25_over("bm2", "docs", "q3")},
  nm AS (SELECT DISTINCT id AS entity_id, lower(trim(unnest(list_concat([trim(name)], coalesce(aliases, []))))) AS name FROM vault_entities WHERE id IS NOT NULL AND name IS NOT NULL),
  rt AS (SELECT query_id, entity_id, count(*) AS times FROM q1 JOIN nm ON nm.name <> '' AND contains(lower(query), nm.name) GROUP BY 1, 2),
  cn AS (SELECT entity_id, source_id, count(*) AS k FROM (SELECT id AS entity_id, unnest(backlinks) AS source_id FROM vault_entities WHERE id IS NOT NULL AND name IS NOT NULL) WHERE source_id IS NOT NULL GROUP BY 1, 2),
  ed AS (SELECT entity_id, source_id, k / (SELECT max(k) FROM cn) AS ew FROM cn), h1 AS (SELECT query_id, source_id, sum(ew * times) AS score FROM rt JOIN ed USING (entity_id) GROUP BY 1, 2),
  wy AS (SELECT query_id, ed.entity_id, count(*) AS ways FROM h1 JOIN ed USING (source_id) WHERE (query_id, ed.entity_id) NOT IN (SELECT query_id, entity_id FROM rt) GROUP BY 1, 2),
  h2 AS (SELECT query_id, source_id, sum(ew * 0.5 * ways) AS score FROM wy JOIN ed USING (entity_id) WHERE (query_id, source_id) NOT IN (SELECT query_id, source_id FROM h1) GROUP BY 1, 2),
  gr0 AS (SELECT query_id, source_id AS doc_id, round(score, 4) AS score FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)), {_ranked("gr0", "gr")},
  fu0 AS (SELECT query_id, doc_id, 2.0 / (60 + rank) AS s FROM ex1 WHERE rank <= 15 UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM ex2 WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 2.0 / (60 + rank) FROM bm1 WHERE rank <= 15
    UNION ALL SELECT query_id, doc_id, 1.5 / (60 + rank) FROM bm2 WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 0.5 / (60 + rank) FROM gr WHERE rank <= 10),
  fu1 AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM fu0 GROUP BY 1, 2), {_ranked("fu1", "fu2")},
  fu3 AS (SELECT query_id, split_part(doc_id, '#fact_', 1) AS doc_id, score, rank, row_number() OVER (PARTITION BY query_id, split_part(doc_id, '#fact_', 1) ORDER BY rank) AS n FROM fu2 WHERE rank <= 30),
  pool AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM fu3 WHERE n = 1)"""


def _flat(x: str) -> str:
    return f"regexp_replace({x}, '[{_SPACE}]+', '', 'g')"


def _rerank_tokens(text: str) -> str:
    """T2 in SQL."""
    raw = rf"regexp_extract_all(lower({text}), '[\x{{4e00}}-\x{{9fff}}]|[a-zA-Z0-9_.-]+')"
    cjk = f"list_filter({raw}, lambda z: z >= '一')"
    return f"list_concat({raw}, list_transform(list_zip({cjk}[:-2], {cjk}[2:]), lambda p: p[1] || p[2]))"


def _rerank(pool: str) -> str:
    """R11 in SQL: sig (query_id, doc_id and the signals), rr (query_id, doc_id, score, rank)."""
    share = lambda keep: f"coalesce(sum(idf) FILTER ({keep}), 0) / sum(idf)"
    return rf"""rq AS (SELECT query_id, query, {_query_terms("query")} AS terms, {_first_of(_joined(_entity_terms("query"), _found("query", f"[{_CJK}]{{3,}}")))} AS wanted FROM qq),
  dn AS (SELECT count(*) AS n FROM docs), dw AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_rerank_tokens("raw")})) AS term FROM docs) GROUP BY 1),
  ti AS (SELECT query_id, term, ln((n + 1) / (coalesce(df, 0) + 1)) + 1.0 AS idf FROM (SELECT query_id, unnest(terms) AS term FROM rq) LEFT JOIN dw USING (term), dn),
  pb0 AS (SELECT p.query_id, p.doc_id, p.rank, max(p.rank) OVER (PARTITION BY p.query_id) AS n, rq.query, rq.wanted, title, page_type, {_clean("lower(raw)")} AS body FROM {pool} p JOIN rq USING (query_id) JOIN docs USING (doc_id)),
  pb AS (SELECT *, {_flat("body")} AS flat, {_rerank_tokens("body")} AS toks, lower(title) AS low_title, body[:greatest(200, greatest(length(body), 1) // 5)] AS head, {_clean("lower(query)")} AS plain FROM pb0),
  ts AS (SELECT query_id, doc_id, {share("list_contains(toks, term) OR contains(flat, term)")} AS tfidf, {share("contains(low_title, term)")} AS title, {share(f"contains(head, term) OR contains({_flat('head')}, term)")} AS position FROM pb JOIN ti USING (query_id) GROUP BY 1, 2),
  oc AS (SELECT query_id, doc_id, term, unnest(list_filter(range(1, length(body) + 1), lambda i: substr(body, i, length(term)) = term)) AS pos FROM pb JOIN ti USING (query_id) WHERE contains(body, term)),
  nx AS (SELECT a.query_id, a.doc_id, a.pos, a.term, b.term AS other, min(b.pos) AS nxt FROM oc a JOIN oc b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.pos >= a.pos GROUP BY 1, 2, 3, 4, 5),
  la AS (SELECT a.query_id, a.doc_id, a.pos, min(b.pos) AS last FROM (SELECT DISTINCT query_id, doc_id, pos FROM oc) a JOIN oc b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.pos >= a.pos + 500 GROUP BY 1, 2, 3),
  de AS (SELECT query_id, doc_id, pos, nxt, row_number() OVER (PARTITION BY query_id, doc_id, pos, term ORDER BY nxt) AS m FROM nx),
  dm AS (SELECT query_id, doc_id, max(m / (1 + (nxt - pos + 1) / 200.0)) FILTER (m > 1 AND nxt <= coalesce(last, 1000000000)) AS best FROM de LEFT JOIN la USING (query_id, doc_id, pos) GROUP BY 1, 2),
  gp AS (SELECT query_id, doc_id, min(gap) AS gap, count(*) AS hits, count(DISTINCT term) AS found FROM (SELECT query_id, doc_id, term, pos, lead(pos) OVER (PARTITION BY query_id, doc_id ORDER BY pos) - pos AS gap FROM oc) GROUP BY 1, 2),
  tg AS (SELECT query_id, doc_id, CASE WHEN hits < 2 THEN found / len(terms) * 0.5 ELSE least(1.0, found / len(terms) * 0.5 + greatest(coalesce(best, 0), 1 / (1 + (gap + 1) / 200.0)) * 0.5) END AS together FROM gp LEFT JOIN dm USING (query_id, doc_id) JOIN rq USING (query_id)),
  rare AS (SELECT query_id, list(term) AS singles FROM ti WHERE length(term) = 1 AND idf > 3.0 GROUP BY 1),
  hi AS (SELECT query_id, unnest(list_distinct(list_filter({_found("lower(query)", f"[{_CJK}]+|[a-zA-Z0-9_.-]+")}, lambda t: length(t) >= 2 OR list_contains(coalesce(singles, []), t)))) AS t FROM rq LEFT JOIN rare USING (query_id)),
  hn AS (SELECT query_id, count(*) AS hn FROM hi GROUP BY 1),
  pa AS (SELECT query_id, doc_id, unnest(string_split(regexp_replace(regexp_replace(body, '\n\s*\n', chr(1), 'g'), '\n(#{{1,3}}\s|[-*]\s)', chr(1) || '\1', 'g'), chr(1))) AS p FROM pb),
  pd AS (SELECT query_id, doc_id, max(k) AS k FROM (SELECT query_id, doc_id, p, count(*) AS k FROM (SELECT DISTINCT query_id, doc_id, p FROM pa WHERE length({_strip("p")}) >= 20) JOIN hi USING (query_id) WHERE contains(lower(p), t) OR contains({_flat("lower(p)")}, t) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  sig AS (SELECT query_id, doc_id, rank, page_type, ts.tfidf, CASE WHEN len(wanted) > 0 THEN len(list_filter(wanted, lambda e: contains(body, lower(e)) OR contains(flat, lower(e)))) / len(wanted) ELSE ts.tfidf END AS coverage,
    CASE WHEN contains(body, plain) OR contains(flat, {_flat("plain")}) THEN 1.0 ELSE 0.0 END AS phrase, ts.title, ts.position, coalesce(together, 0) AS together, 1.0 - (rank - 1) / n AS original, coalesce(k / hn, 0) AS density
    FROM pb JOIN ts USING (query_id, doc_id) LEFT JOIN tg USING (query_id, doc_id) LEFT JOIN pd USING (query_id, doc_id) LEFT JOIN hn USING (query_id)),
  sb AS (SELECT *, tfidf * 0.25 + coverage * 0.10 + phrase * 0.10 + title * 0.15 + position * 0.15 + together * 0.10 + original * 0.05 AS base FROM sig),
  rr0 AS (SELECT query_id, doc_id, round(CASE WHEN page_type = 'entity' AND NOT (phrase > 0.5 OR coverage > 0.7) THEN base * 0.5 ELSE base END + density * 0.08, 4) AS score FROM sb), {_ranked("rr0", "rr")}"""


@query(f"WITH {_engine()}, {_rerank('pool')} SELECT query_id, rank, doc_id, score FROM rr WHERE rank <= 5")
def engine_search(spark: SparkSession, d: str) -> DataFrame:
    """Exact, BM25 and graph lists, fusion, parents and reranking over the vault, which has no vectors."""
    return engine.search(corpus.vault_index(spark, d), corpus.document_queries(spark, d), 5)


@query(f"WITH {_engine()}, {_rerank('pool')} SELECT query_id, doc_id, {', '.join(f'round({c}, 4) AS {c}' for c in ('tfidf', 'coverage', 'phrase', 'title', 'position', 'together', 'original', 'density'))} FROM sig")
def rerank_signals(spark: SparkSession, d: str) -> DataFrame:
    """R11a to R11i: every signal of each query's pool."""
    index, q = corpus.vault_index(spark, d), corpus.document_queries(spark, d)
    found = rerank.signals(engine.pool(index, q, 5), index.docs, q, index.search.frequencies)
    return found.select("query_id", "doc_id", *(F.round(c, 4).alias(c) for c in ("tfidf", "coverage", "phrase", "title", "position", "together", "original", "density")))


@query(f"WITH {_engine(facts=True)} SELECT query_id, rank, doc_id, score FROM pool WHERE rank <= 5")
def engine_facts(spark: SparkSession, d: str) -> DataFrame:
    """R9, R10 over an index with the sources' incidental facts as children, shown as their parents."""
    return engine.search(corpus.vault_index(spark, d, facts=True), corpus.document_queries(spark, d), 5, reranked=False)


@query(
    f"""WITH {_CLAIMS}, t AS (SELECT claim_id, entity_id, {_set("text")} AS toks FROM c WHERE entity_id IS NOT NULL AND text IS NOT NULL),
    p AS (SELECT a.claim_id AS a, b.claim_id AS b, len(list_intersect(a.toks, b.toks)) AS k, len(a.toks) + len(b.toks) AS n FROM t a JOIN t b ON a.entity_id = b.entity_id AND a.claim_id < b.claim_id AND len(a.toks) > 0 AND len(b.toks) > 0)
    SELECT a, b, round(k / (n - k), 6) AS similarity FROM p WHERE k / (n - k) >= {L.SAME_FACT} - 1e-12"""
)
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Like claims of an entity."""
    c = corpus.claims(spark, d).where("entity_id is not null and text is not null")
    items = c.select(F.col("claim_id").alias("id"), F.col("entity_id").alias("grp"), T.jaccard_tokens(F.col("text")).alias("tokens"))
    return leader.similar_pairs(items, L.SAME_FACT).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_engine()} SELECT query_id, rank, doc_id, score FROM pool WHERE rank <= 5")
def engine_fused(spark: SparkSession, d: str) -> DataFrame:
    """R9 without reranking."""
    return engine.search(corpus.vault_index(spark, d), corpus.document_queries(spark, d), 5, reranked=False)


@query(
    f"""WITH {_BM25}, h AS (SELECT query_id, min(CASE WHEN doc_id = query_id THEN rank END) AS hit FROM qq LEFT JOIN (SELECT * FROM bm WHERE rank <= 20) b USING (query_id) GROUP BY 1)
    SELECT count(*) AS queries, round(avg((coalesce(hit <= 1, false))::int), 4) AS recall_1, round(avg((coalesce(hit <= 5, false))::int), 4) AS recall_5, round(avg((coalesce(hit <= 10, false))::int), 4) AS recall_10,
      round(avg((coalesce(hit <= 20, false))::int), 4) AS recall_20, round(avg(coalesce(1.0 / hit, 0)), 4) AS mrr, round(avg(CASE WHEN hit <= 10 THEN 1.0 / log2(hit + 1) ELSE 0 END), 4) AS ndcg_10 FROM h"""
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """B1, B2 of BM25; a query's gold is the document it was taken from."""
    q = corpus.document_queries(spark, d)
    ranked = retrieval.bm25(corpus.documents_index(spark, d), q, 20)
    return evaluate.metrics(evaluate.hit_ranks(ranked, q.select("query_id", F.col("query_id").alias("doc_id")), q))


# --- events -----------------------------------------------------------------------------


@query("SELECT id, source_id, session_id, agent, ts, role, content FROM agent_events WHERE \"type\" = 'message' AND agent = 'hermes' AND ts >= 1740000000 AND ts <= 1750000000")
def event_filter(spark: SparkSession, d: str) -> DataFrame:
    """F1."""
    return events.select_events(table(spark, d, "agent_events"), type="message", agent="hermes", since=1740000000, until=1750000000).select("id", "source_id", "session_id", "agent", "ts", "role", "content")


@query("SELECT id, ts, \"type\", name FROM agent_events WHERE \"type\" = 'error' ORDER BY ts DESC, id DESC LIMIT 100")
def event_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last hundred errors, the feature's default limit."""
    return events.query_events(table(spark, d, "agent_events"), type="error", descending=True).select("id", "ts", "type", "name")


@query(
    """SELECT dimension, value, sum(n)::BIGINT AS n FROM (
      SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM agent_events
      UNION ALL SELECT 'sessions', '', count(DISTINCT session_id) FROM agent_events WHERE session_id <> ''
      UNION ALL SELECT 'type', coalesce("type", ''), count(*) FROM agent_events GROUP BY 2
      UNION ALL SELECT 'agent', coalesce(agent, ''), count(*) FROM agent_events GROUP BY 2) GROUP BY 1, 2"""
)
def event_stats(spark: SparkSession, d: str) -> DataFrame:
    """E5."""
    return events.stats(table(spark, d, "agent_events"))


@query("SELECT session_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (\"type\" = 'message') AS messages FROM agent_events WHERE session_id <> '' GROUP BY 1")
def event_by_session(spark: SparkSession, d: str) -> DataFrame:
    """E4 for all sessions."""
    x = table(spark, d, "agent_events").where("session_id <> ''")
    return x.groupBy("session_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("type") == "message").alias("messages"))


@query("SELECT id FROM agent_events WHERE source_id IS NULL OR source_id NOT IN (SELECT id FROM vault_sources WHERE source_type = 'tool_trace' AND id IS NOT NULL)")
def event_delete(spark: SparkSession, d: str) -> DataFrame:
    """The table without the events of tool traces."""
    gone = table(spark, d, "vault_sources").where("source_type = 'tool_trace' and id is not null").select(F.col("id").alias("source_id"))
    return events.without_source(table(spark, d, "agent_events"), gone).select("id")


@query(
    """SELECT min(id) AS id FROM agent_events GROUP BY source_id, session_id, agent, ts, "type", role, name, content, args_json, result, error, path, metadata_json"""
)
def event_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Events stored again count once."""
    return events.distinct_events(table(spark, d, "agent_events")).select("id")


@query()
def event_append(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the documents' events add to the table."""
    parsed = umsf.parse(table(spark, d, "umsf_raw"))
    return events.append_rows(parsed.select(F.col("umsf_id").cast("string").alias("source_id"), "session_id", "agent", "events"))


# --- event documents --------------------------------------------------------------------


_DOCUMENTS = f"""j AS (SELECT umsf_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM umsf_raw),
    k AS (SELECT umsf_id, p, json_type(p) AS t, coalesce(json_type(p, '$.events'), 'NULL') AS te, coalesce(json_type(p, '$.actors'), 'NULL') AS ta, json_extract(p, '$.context') AS c0 FROM j),
    m0 AS (SELECT *, CASE WHEN json_type(c0) = 'VARCHAR' AND json_valid(c0->>'$') THEN (c0->>'$')::JSON ELSE c0 END AS c,
      CASE te WHEN 'ARRAY' THEN list_filter(json_extract(p, '$.events[*]'), lambda e: json_type(e) = 'OBJECT') WHEN 'OBJECT' THEN [json_extract(p, '$.events')] ELSE [] END AS ev FROM k),
    m AS (SELECT *, len(ev) AS n FROM m0),
    ver AS (SELECT *, CASE WHEN t IS NULL OR t <> 'OBJECT' THEN 'not a document' WHEN NOT starts_with(coalesce(p->>'$.schema', 'ak/v1'), 'ak/') THEN 'unknown schema'
      WHEN coalesce(p->>'$.source_type', 'conversation') NOT IN {L.SOURCE_TYPES} THEN 'unknown source type' WHEN te NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN 'events is no list'
      WHEN ta NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN 'actors is no list' WHEN n = 0 AND coalesce(p->>'$.summary', '') = '' AND coalesce(c->>'$.body', '') = '' THEN 'nothing to ingest' ELSE 'accepted' END AS verdict FROM m)"""


def _field(name: str, of: str = "e") -> str:
    return f"coalesce({of}->>'$.{name}', '')"


def _either(*cs: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} <> '' THEN {c}" for c in cs) + " ELSE '' END"


def _args_summary() -> str:
    """U3 in SQL; an object's arguments in the order of their names, those of a text as written."""
    a = "CASE WHEN json_type(e, '$.args') = 'VARCHAR' THEN CASE WHEN json_valid(e->>'$.args') THEN (e->>'$.args')::JSON END ELSE json_extract(e, '$.args') END"
    keys = f"CASE WHEN json_type({a}) = 'OBJECT' THEN CASE WHEN json_type(e, '$.args') = 'VARCHAR' THEN json_keys({a}) ELSE list_sort(json_keys({a})) END ELSE [] END"
    v = f"json_extract_string({a}, '/' || replace(replace(k, '~', '~0'), '/', '~1'))"
    one = f"k || '=' || CASE WHEN {v} IS NULL OR regexp_matches({v}, '^\\s*[\\[{{]') THEN '…' WHEN length({v}) > 60 THEN {v}[:60] || '…' ELSE {v} END"
    return f"array_to_string(list_concat(list_transform(({keys})[1:3], lambda k: {one}), CASE WHEN len({keys}) >= 3 THEN ['…'] ELSE [] END), ', ')"


def _lines(types: tuple[str, ...], line: str) -> str:
    return f"list_transform(list_filter(ev, lambda e: list_contains({list(types)!r}, e->>'$.type')), lambda e: {line})"


_SAID = _strip(_either(_field("content"), _field("error")))
_SECTIONS_OF = (
    ("decisions", _lines(("decision",), f"'- ' || {_strip(_field('content'))} || CASE WHEN {_field('rationale')} <> '' THEN ' — rationale: ' || {_strip(_field('rationale'))} ELSE '' END")),
    ("actions", _lines(("tool_use", "tool_result"), f"CASE WHEN e->>'$.type' = 'tool_use' THEN CASE WHEN {_field('name')} <> '' THEN '- ' || (e->>'$.name') || '(' || {_args_summary()} || ')' ELSE '- ' || {_strip(_field('content'))} END ELSE '- result: ' || replace({_strip(_either(_field('result'), _field('error'), _field('content')))}, chr(10), ' ')[:200] END")),
    ("actions", _lines(("file_change",), f"rtrim('- ' || {_either(_field('name'), chr(39) + 'modified' + chr(39))} || ' ' || {_field('path')}, ' ')")),
    ("risks", _lines(("error",), f"CASE WHEN {_SAID} <> '' THEN '- ' || {_SAID}[:300] ELSE '' END")),
    ("conversation", _lines(("message",), f"CASE WHEN {_strip(_field('content'))} <> '' THEN '**' || {_either(_field('role'), chr(39) + 'speaker' + chr(39))} || '**: ' || {_strip(_field('content'))} ELSE '' END")),
)
_P = lambda n: _field(n, "p")
_HEAD = _strip(f"split_part({_strip(_P('summary'))}, '.', 1)")
_RENDERED = f"""{_DOCUMENTS}, ti AS (SELECT umsf_id, p, ev, coalesce(c->>'$.body', '') AS body, CASE WHEN {_P('title')} <> '' THEN {_P('title')} WHEN length({_HEAD}) > 6 AND length({_HEAD}) < 100 THEN {_HEAD}
      ELSE array_to_string(list_filter([{_P('agent')}, {_P('source_type')}, CASE WHEN {_P('session_id')} <> '' THEN 'session ' || {_P('session_id')}[:8] ELSE '' END], lambda x: x <> ''), ' · ') END AS title FROM ver WHERE verdict = 'accepted'),
    hd AS (SELECT *, CASE WHEN title <> '' THEN ['# ' || title] ELSE [] END AS head, CASE WHEN {_P('summary')} <> '' THEN ['## summary', {_strip(_P('summary'))}] ELSE [] END AS su, {", ".join(f"{q} AS l{i}" for i, (_, q) in enumerate(_SECTIONS_OF))} FROM ti),
    md AS (SELECT umsf_id, array_to_string(list_filter(CASE WHEN p->>'$.source_type' = 'curated_memory' THEN list_concat(head, [{_strip(_either("body", _P('summary')))}])
      ELSE {_joined("head", "su", *(f"CASE WHEN len(l{i}) > 0 THEN list_concat(['## {name}'], l{i}) ELSE [] END" for i, (name, _) in enumerate(_SECTIONS_OF)))} END, lambda x: x <> ''), chr(10) || chr(10)) AS markdown FROM hd)"""


@query(f"WITH {_DOCUMENTS} SELECT umsf_id, verdict FROM ver")
def umsf_validate(spark: SparkSession, d: str) -> DataFrame:
    """each document's verdict."""
    parsed = umsf.parse(table(spark, d, "umsf_raw"))
    return parsed.select("umsf_id", F.coalesce(umsf.problem(parsed), F.lit("accepted")).alias("verdict"))


@query(f"WITH {_RENDERED} SELECT umsf_id, markdown FROM md")
def umsf_render(spark: SparkSession, d: str) -> DataFrame:
    """U2 to U4."""
    accepted, _ = umsf.validate(umsf.parse(table(spark, d, "umsf_raw")))
    return umsf.render(accepted)


@query(f"WITH {_RENDERED}, s AS (SELECT umsf_id AS id, markdown AS content FROM md), {_EXTRACT} SELECT id, ordinal, text, tag, weight, durability, polarity FROM x")
def umsf_claims(spark: SparkSession, d: str) -> DataFrame:
    """Documents rendered and compiled into claims."""
    accepted, _ = umsf.validate(umsf.parse(table(spark, d, "umsf_raw")))
    # written out: extraction reads the text many times, and the rendering would be computed anew for each
    rendered = cut_lineage(umsf.render(accepted).select(F.col("umsf_id").alias("id"), F.col("markdown").alias("content")))
    return C.extract(rendered).select("id", "ordinal", "text", "tag", "weight", "durability", "polarity")


# --- hooks ------------------------------------------------------------------------------


def _fired(spark: SparkSession, d: str, name: str) -> DataFrame:
    return hooks.Registry().fire(table(spark, d, "agent_events")).where(F.col("hook") == name)


_C = "coalesce(content, '')"


@query(
    f"""SELECT id AS event_id, {_C}[:500] AS text, list_filter([CASE WHEN {_signal(_C, L.PREFERENCE)} THEN 'preference' END, CASE WHEN {_signal(_C, L.DIRECTIVE)} THEN 'directive' END,
      CASE WHEN {_signal(_C, L.HOOK_FORESIGHT)} THEN 'foresight' END], lambda t: t IS NOT NULL) AS tags, CASE WHEN {_signal(_C, L.HOOK_FORESIGHT)} THEN 'temporary' ELSE 'stable' END AS durability
    FROM agent_events WHERE "type" = 'message' AND coalesce(role, '') IN ('', 'user') AND length({_C}) >= 5
      AND ({_signal(_C, L.PREFERENCE)} OR {_signal(_C, L.DIRECTIVE)} OR {_signal(_C, L.HOOK_FORESIGHT)})"""
)
def hook_message(spark: SparkSession, d: str) -> DataFrame:
    """H1."""
    return _fired(spark, d, "message").select("event_id", "text", "tags", "durability")


@query(
    f"""SELECT id AS event_id, {_C}[:500] AS text, CASE WHEN {_signal(_C, L.CORRECTION)} THEN 'stable' ELSE 'temporary' END AS durability
    FROM agent_events WHERE "type" = 'message' AND role = 'assistant' AND length({_C}) >= 5 AND ({_signal(_C, L.COMMITMENT)} OR {_signal(_C, L.CORRECTION)})"""
)
def hook_response(spark: SparkSession, d: str) -> DataFrame:
    """H2."""
    return _fired(spark, d, "response").select("event_id", "text", "durability")


@query(
    f"""SELECT id AS event_id, {_C}[:500] AS text, 0.85::DOUBLE AS confidence FROM agent_events WHERE "type" IN ('decision', 'message') AND length({_C}) >= 5 AND {_signal(_C, L.HOOK_DECISION)}"""
)
def hook_decision(spark: SparkSession, d: str) -> DataFrame:
    """H6."""
    return _fired(spark, d, "decision").select("event_id", "text", "confidence")


@query(
    """SELECT id AS event_id, ('Error: ' || CASE WHEN coalesce(error, '') <> '' THEN error ELSE coalesce(content, '') END || CASE WHEN coalesce(name, '') <> '' THEN ' | Tool: ' || name ELSE '' END)[:500] AS text
    FROM agent_events WHERE "type" = 'error' AND (coalesce(error, '') <> '' OR coalesce(content, '') <> '')"""
)
def hook_error(spark: SparkSession, d: str) -> DataFrame:
    """H4."""
    return _fired(spark, d, "error").select("event_id", "text")


_ARGS = "CASE WHEN json_valid(args_json) AND json_type(args_json) = 'OBJECT' THEN args_json END"


@query(
    rf"""WITH t AS (SELECT id, name, {_ARGS} AS a, regexp_extract_all(coalesce(result, '')[:2000], '(?i){L.RESULT_KEYS}', 1)[1:5] AS ks FROM agent_events WHERE "type" = 'tool_use' AND coalesce(name, '') <> ''),
    u AS (SELECT *, array_to_string(list_transform(json_keys(a)[1:5], lambda k: k || '=' || coalesce(json_extract_string(a, '/' || replace(replace(k, '~', '~0'), '/', '~1')), 'null')), ', ') AS args FROM t)
    SELECT id AS event_id, ('Tool: ' || name || CASE WHEN coalesce(args, '') <> '' THEN ' | Args: ' || args ELSE '' END || CASE WHEN len(ks) > 0 THEN ' | Keys: ' || array_to_string(ks, ', ') ELSE '' END)[:500] AS text, ['tool_use', name] AS tags FROM u"""
)
def hook_tool(spark: SparkSession, d: str) -> DataFrame:
    """H3."""
    return _fired(spark, d, "tool_use").select("event_id", "text", "tags")


@query(
    f"""SELECT hook, count(*) AS fired FROM (
      SELECT unnest(list_filter([
        CASE WHEN "type" = 'message' AND coalesce(role, '') IN ('', 'user') AND length({_C}) >= 5 AND ({_signal(_C, L.PREFERENCE)} OR {_signal(_C, L.DIRECTIVE)} OR {_signal(_C, L.HOOK_FORESIGHT)}) THEN 'message' END,
        CASE WHEN "type" = 'message' AND role = 'assistant' AND length({_C}) >= 5 AND ({_signal(_C, L.COMMITMENT)} OR {_signal(_C, L.CORRECTION)}) THEN 'response' END,
        CASE WHEN "type" = 'tool_use' AND coalesce(name, '') <> '' THEN 'tool_use' END,
        CASE WHEN "type" = 'error' AND (coalesce(error, '') <> '' OR {_C} <> '') THEN 'error' END,
        CASE WHEN "type" IN ('decision', 'message') AND length({_C}) >= 5 AND {_signal(_C, L.HOOK_DECISION)} THEN 'decision' END,
        CASE WHEN "type" = 'session_end' AND json_valid(metadata_json) AND coalesce(json_array_length(CASE WHEN json_valid(metadata_json) THEN metadata_json END, '$.messages'), 0) >= 2 THEN 'session' END],
        lambda h: h IS NOT NULL)) AS hook FROM agent_events) GROUP BY 1"""
)
def hook_counts(spark: SparkSession, d: str) -> DataFrame:
    """H0."""
    return hooks.Registry().counts(table(spark, d, "agent_events"))


@query(
    """WITH e AS (SELECT DISTINCT session_id FROM agent_events WHERE "type" = 'session_end' AND session_id <> ''),
    m AS (SELECT session_id, ts, id, '[' || CASE WHEN coalesce(role, '') <> '' THEN role ELSE 'unknown' END || '] ' || content[:200] AS line FROM agent_events JOIN e USING (session_id) WHERE "type" = 'message' AND content <> '')
    SELECT session_id, count(*) AS messages, string_agg(line, chr(10) ORDER BY ts, id)[:5000] AS summary FROM m GROUP BY 1 HAVING count(*) >= 2"""
)
def hook_session(spark: SparkSession, d: str) -> DataFrame:
    """H5, T18."""
    return hooks.session_summaries(table(spark, d, "agent_events"))


# --- claims -----------------------------------------------------------------------------


@query(f"WITH {_SOURCES}, {_EXTRACT} SELECT * FROM x")
def claim_extract(spark: SparkSession, d: str) -> DataFrame:
    """X1 to X4 over the sources."""
    return C.extract(corpus.sources(spark, d))


@query(f"WITH {_CLAIMS} SELECT claim_id, {_polarity('text')} AS polarity FROM c WHERE text IS NOT NULL")
def claim_polarity(spark: SparkSession, d: str) -> DataFrame:
    """X5."""
    return corpus.claims(spark, d).where("text is not null").select("claim_id", T.polarity(F.col("text")).alias("polarity"))


@query(
    f"""WITH {_CLAIMS} SELECT claim_id, CASE WHEN coalesce(tags[1], '') = 'decision' THEN 'stable' WHEN coalesce(tags[1], '') = 'todo' THEN 'temporary' WHEN {_signal("text", L.TEMPORARY)} THEN 'temporary' ELSE 'unknown' END AS durability
    FROM c WHERE text IS NOT NULL"""
)
def claim_durability(spark: SparkSession, d: str) -> DataFrame:
    """X4."""
    tag = F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit(""))
    return corpus.claims(spark, d).where("text is not null").select("claim_id", T.durability(F.col("text"), tag).alias("durability"))


@query(
    f"""WITH {_CLAIMS}, w AS (SELECT claim_id, coalesce(list_sum(list_transform(evidence, lambda e: e.weight)), 0) AS w FROM c)
    SELECT claim_id, round(least(0.95, w / (w + 1)), 3) AS confidence FROM w"""
)
def claim_confidence(spark: SparkSession, d: str) -> DataFrame:
    """X6."""
    weights = F.coalesce(F.filter(F.transform("evidence", lambda e: e["weight"]), lambda w: w.isNotNull()), F.array().cast("array<double>"))
    return corpus.claims(spark, d).select("claim_id", F.round(T.confidence(weights), 3).alias("confidence"))


@query(
    f"""WITH {_CLAIMS} SELECT claim_id, text[:500] AS text, {AS_OF}::DOUBLE + 86400 * {_case([(_signal("text", p), str(n)) for p, n in L.FORESIGHT_DAYS], str(L.FORESIGHT_DEFAULT_DAYS))} AS valid_until
    FROM c WHERE {_signal("text", L.FORESIGHT)}"""
)
def foresight(spark: SparkSession, d: str) -> DataFrame:
    """X7."""
    return C.foresight(corpus.claims(spark, d).select("claim_id", "text"), AS_OF).select("claim_id", "text", "valid_until")


@query(
    f"""WITH {_CLAIMS}, k AS (SELECT coalesce(entity_id, '') AS entity_id, lower({_strip("text")}) AS key, claim_id, created_at, evidence FROM c WHERE text IS NOT NULL),
    f AS (SELECT entity_id, key, arg_min(claim_id, (created_at, claim_id)) AS claim_id FROM k GROUP BY 1, 2),
    s AS (SELECT entity_id, key, e.source_id AS source_id, max(e.weight) AS w FROM (SELECT entity_id, key, unnest(evidence) AS e FROM k) GROUP BY 1, 2, 3),
    t AS (SELECT entity_id, key, count(*) AS sources, round(sum(w), 6) AS weight FROM s GROUP BY 1, 2)
    SELECT entity_id, claim_id, coalesce(sources, 0) AS sources, coalesce(weight, 0) AS weight, round(least(0.95, coalesce(weight, 0) / (coalesce(weight, 0) + 1)), 3) AS confidence FROM f LEFT JOIN t USING (entity_id, key)"""
)
def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    """K2."""
    return truth.merge_evidence(corpus.claims(spark, d)).select("entity_id", "claim_id", "sources", "weight", "confidence")


@query(
    f"""WITH {_CLAIMS}, n AS (SELECT e.source_id AS source_id, entity_id, count(*) AS n FROM (SELECT entity_id, unnest(evidence) AS e FROM c WHERE entity_id IS NOT NULL) GROUP BY 1, 2),
    m AS (SELECT DISTINCT unnest(backlinks) AS source_id, id AS entity_id FROM vault_entities WHERE id IS NOT NULL AND name IS NOT NULL), {_SOURCES}
    SELECT entity_id, source_id, '2026-01-01' AS date, 'New evidence from: ' || coalesce(title, '') AS title, 'Extracted ' || coalesce(n, 0) || ' claims' AS body
    FROM m LEFT JOIN n USING (source_id, entity_id) LEFT JOIN s ON s.id = source_id"""
)
def timeline(spark: SparkSession, d: str) -> DataFrame:
    """K4."""
    on = corpus.claims(spark, d).where("entity_id is not null").select("entity_id", F.explode("evidence.source_id").alias("source_id"))
    mentions = corpus.entities(spark, d).select(F.col("id").alias("entity_id"), F.explode("backlinks").alias("source_id"))
    return truth.timeline(mentions, on, corpus.sources(spark, d), AS_OF)


@query(
    f"WITH {_CLAIMS}, {_SUMMARY} SELECT entity_id, summary FROM su"
)
def truth_summary(spark: SparkSession, d: str) -> DataFrame:
    """K5."""
    return truth.summaries(corpus.claims(spark, d))


@query(
    f"""WITH {_CLAIMS}, x AS (SELECT entity_id, CASE WHEN coalesce(polarity, 'neutral') <> 'neutral' THEN polarity ELSE {_polarity("text")} END AS p
      FROM c WHERE status = 'active' AND entity_id IS NOT NULL AND text IS NOT NULL AND confidence > 0.5),
    g AS (SELECT entity_id, count(*) FILTER (p = 'positive') AS positives, count(*) FILTER (p = 'negative') AS negatives FROM x GROUP BY 1)
    SELECT entity_id, positives, negatives, positives * negatives AS pairs FROM g WHERE positives > 0 AND negatives > 0"""
)
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    """K9, K11."""
    return truth.contradictions(corpus.claims(spark, d))


@query(
    f"""WITH RECURSIVE o AS (SELECT fact_id AS id, any_value(coalesce(entities[1], '')) AS grp, any_value(coalesce(fact, '')) AS text, any_value(coalesce("timestamp", 0)) AS t FROM consolidated_facts WHERE fact_id IS NOT NULL GROUP BY 1),
    it AS (SELECT id, grp, {_set("text")} AS toks, row_number() OVER (PARTITION BY grp ORDER BY -t, id) AS i FROM o), {_greedy("it", L.SAME_FACT)}
    SELECT id, leader, CASE WHEN id = leader THEN 1.0 ELSE {L.ABSORBED_WEIGHT} END::DOUBLE AS weight FROM it_led"""
)
def consolidate(spark: SparkSession, d: str) -> DataFrame:
    """K6 over the facts, within each first entity."""
    f = table(spark, d, "consolidated_facts").where("fact_id is not null")
    one = f.groupBy(F.col("fact_id").alias("id")).agg(F.min(F.struct("fact", "timestamp", "entities")).alias("r"))
    grp = F.coalesce(F.try_element_at("r.entities", F.lit(1)), F.lit(""))
    return truth.consolidate(one.select("id", grp.alias("grp"), F.col("r.fact").alias("text"), "r.timestamp"))


@query(
    f"""WITH RECURSIVE {_CLAIMS}, o AS (SELECT claim_id AS id, entity_id AS grp, text, coalesce(created_at, 0) AS t, coalesce(durability = 'temporary', false) AS tmp FROM c WHERE status = 'active' AND entity_id IS NOT NULL AND text IS NOT NULL),
    it AS (SELECT id, grp, {_set("text")} AS toks, row_number() OVER (PARTITION BY grp ORDER BY -t, id) AS i FROM o), {_greedy("it", L.SAME_FACT)},
    k AS (SELECT o.* FROM o JOIN it_led USING (id) WHERE leader = id),
    it2 AS (SELECT id, grp, tmp, {_set("text")} AS toks, row_number() OVER (PARTITION BY grp ORDER BY -t, id) AS i FROM k), {_greedy("it2", L.SAME_TEMPORARY, "a.tmp OR b.tmp")}
    SELECT o.id AS claim_id, CASE WHEN it2_led.leader = o.id THEN 'active' ELSE 'superseded' END AS status FROM o LEFT JOIN it2_led ON it2_led.id = o.id"""
)
def claim_supersede(spark: SparkSession, d: str) -> DataFrame:
    """K7, K8."""
    return truth.supersede(corpus.claims(spark, d))


# --- entities ---------------------------------------------------------------------------


@query(f"WITH {_TYPED} SELECT * FROM ty")
def entity_typed(spark: SparkSession, d: str) -> DataFrame:
    """X8, X9."""
    return entities.typed(corpus.sources(spark, d))


@query(
    f"""WITH {_TYPED}, ca AS ({_candidates_sql()}), al AS (SELECT id, name, type, 0 AS p FROM ty UNION ALL SELECT id, name, {_suffix("name")}, 2 FROM ca)
    SELECT id, name, arg_min(type, p) AS type FROM al GROUP BY 1, 2"""
)
def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    """X11 to X14, F5."""
    return entities.extract(corpus.sources(spark, d))


@query(
    f"""SELECT DISTINCT trim(name) AS name, {_case([(f"regexp_matches(trim(name), '{p}')", f"'{t}'") for t, p in L.SUFFIXES], "'named'")} AS type FROM vault_entities WHERE id IS NOT NULL AND name IS NOT NULL"""
)
def entity_suffix(spark: SparkSession, d: str) -> DataFrame:
    """X13."""
    return corpus.entities(spark, d).select("name", T.suffix_type(F.col("name")).alias("type")).distinct()


@query(
    f"""WITH {_SOURCES}, f AS (SELECT DISTINCT unnest(entities_extracted) AS name FROM vault_sources),
    n AS (SELECT id, unnest(list_concat([trim(name)], coalesce(aliases, []))) AS n FROM vault_entities WHERE id IS NOT NULL AND name IS NOT NULL),
    k AS (SELECT lower(trim(n)) AS low, min(id) AS id FROM n WHERE lower(trim(n)) <> '' GROUP BY 1)
    SELECT name, coalesce(id, sha256(lower(trim(name)))[:8]) AS entity_id, id IS NULL AS is_new FROM f LEFT JOIN k ON low = lower(trim(name))"""
)
def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The sources' extracted names against the known entities."""
    found = table(spark, d, "vault_sources").select(F.explode("entities_extracted").alias("name"))
    return entities.resolve(found, corpus.entities(spark, d))


@query(
    f"""WITH {_CLAIMS}, src AS (SELECT claim_id, text, unnest(evidence).source_id AS source_id FROM c WHERE text IS NOT NULL),
    n AS (SELECT DISTINCT unnest(backlinks) AS source_id, id AS entity_id, trim(name) AS name FROM vault_entities WHERE id IS NOT NULL AND name IS NOT NULL),
    m AS (SELECT claim_id, entity_id, name, instr(lower(text), lower(name)) AS pos FROM src JOIN n USING (source_id))
    SELECT claim_id, arg_min(entity_id, (pos, -length(name), name, entity_id)) AS entity_id FROM m WHERE pos > 0 GROUP BY 1"""
)
def entity_link(spark: SparkSession, d: str) -> DataFrame:
    """Claims to the entities of their sources."""
    c = corpus.claims(spark, d).where("text is not null").select("claim_id", "text", F.explode("evidence.source_id").alias("source_id")).distinct()
    n = corpus.entities(spark, d).select(F.explode("backlinks").alias("source_id"), F.col("id").alias("entity_id"), "name").distinct()
    return entities.link(c, n, ["source_id"])


# --- dream ------------------------------------------------------------------------------


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """The active claims with their D3 cluster sizes and whether their entity is in several clusters."""
    c = truth.active(corpus.claims(spark, d)).where("text is not null")
    clustered = cut_lineage(dream.clusters(c.select("claim_id", "text", "created_at"), [F.col("created_at")]))
    crossing = dream.across(clustered, c).withColumn("crosses", F.lit(True))
    zero = F.lit(0)
    return c.join(clustered, "claim_id").join(crossing, "entity_id", "left").select(
        "claim_id", "text", "tags", "durability", "created_at", "entity_id", F.coalesce(F.size(F.filter("evidence", lambda e: e.isNotNull())), zero).alias("evidence_count"),
        F.coalesce(F.size(F.array_distinct(F.transform("evidence", lambda e: e["source_id"]))), zero).alias("source_count"), F.col("size").alias("cluster_size"), F.coalesce("crosses", F.lit(False)).alias("crosses"),
    )


_SCORE = f"""RECURSIVE {_CLAIMS}, v AS (SELECT * FROM c WHERE status = 'active' AND text IS NOT NULL),
  it AS (SELECT claim_id AS id, '' AS grp, {_set("text")} AS toks, row_number() OVER (ORDER BY created_at NULLS FIRST, claim_id) AS i FROM v), {_greedy("it", L.DREAM_CLUSTER)},
  z AS (SELECT id AS claim_id, leader, count(*) OVER (PARTITION BY leader) AS cs FROM it_led),
  cr AS (SELECT entity_id FROM v JOIN z USING (claim_id) WHERE entity_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT leader) > 1),
  x AS (SELECT v.*, cs, (cr.entity_id IS NOT NULL)::INT AS crosses, coalesce(len(list_filter(evidence, lambda e: e IS NOT NULL)), 0) AS ev, coalesce(len(list_distinct(list_transform(evidence, lambda e: e.source_id))), 0) AS sc
    FROM v JOIN z USING (claim_id) LEFT JOIN cr USING (entity_id)),
  y AS (SELECT claim_id, text, round(0.24 * least(1, least(1, ev / 3.0) + least(0.3, (cs - 1) * 0.1))
    + 0.30 * CASE WHEN list_contains(tags, 'decision') THEN 0.9 WHEN list_contains(tags, 'learning') THEN 0.8 WHEN list_contains(tags, 'action') THEN 0.6 WHEN list_contains(tags, 'todo') THEN 0.3 ELSE 0.4 END
    + 0.15 * least(1, sc / 2.0) + 0.15 * pow(2, -((({AS_OF}::DOUBLE - created_at) / 86400) / CASE durability WHEN 'temporary' THEN 3 WHEN 'stable' THEN 30 ELSE 7 END))
    + 0.10 * CASE WHEN entity_id IS NOT NULL THEN 0.7 ELSE 0.2 END + 0.06 * least(1, least(1, length(text) / 100.0) + 0.3 * crosses), 6) AS score FROM x)"""


@query(f"WITH {_SCORE} SELECT claim_id, score, score >= 0.45 AS promoted FROM y")
def dream_score(spark: SparkSession, d: str) -> DataFrame:
    """D4, D5."""
    return dream.score(_candidates(spark, d), AS_OF).select("claim_id", "score", "promoted")


@query(f"WITH {_SCORE} SELECT count(*) AS candidates, count(*) FILTER (score >= 0.45) AS promoted, count(*) FILTER (score < 0.45) AS discarded, round(avg(score), 4) AS mean_score FROM y")
def dream_report(spark: SparkSession, d: str) -> DataFrame:
    """D6."""
    return dream.report(dream.score(_candidates(spark, d), AS_OF))


@query(
    f"""WITH {_SOURCES.replace("s AS (", "s0 AS (", 1)}, s AS (SELECT * FROM s0 WHERE ingested_at >= {AS_OF} - 90 * 24 * 3600), {_EXTRACT}
    SELECT sha256(id || chr(31) || ordinal || chr(31) || text)[:8] AS claim_id, id AS source_id, ordinal, text, tag, durability, weight FROM x"""
)
def dream_light(spark: SparkSession, d: str) -> DataFrame:
    """Candidates from the last ninety days."""
    return dream.light(corpus.sources(spark, d), AS_OF, 24.0 * 90)


@query(
    f"""WITH RECURSIVE o AS (SELECT fact_id AS id, any_value(coalesce(fact, '')) AS text, any_value(coalesce("timestamp", 0)) AS t FROM consolidated_facts WHERE fact_id IS NOT NULL GROUP BY 1),
    it AS (SELECT id, '' AS grp, {_set("text")} AS toks, row_number() OVER (ORDER BY t, id) AS i FROM o), {_greedy("it", L.DREAM_CLUSTER)}
    SELECT id AS claim_id, leader, count(*) OVER (PARTITION BY leader) AS size FROM it_led"""
)
def dream_clusters(spark: SparkSession, d: str) -> DataFrame:
    """D3 over the distinct facts."""
    f = table(spark, d, "consolidated_facts").where("fact_id is not null")
    one = f.groupBy(F.col("fact_id").alias("claim_id")).agg(F.min(F.struct("timestamp", "fact")).alias("r")).select("claim_id", F.col("r.fact").alias("text"), F.coalesce("r.timestamp", F.lit(0.0)).alias("t"))
    return dream.clusters(one, [F.col("t")])


@query(
    f"""WITH {_CLAIMS}, v AS (SELECT claim_id, {AS_OF}::DOUBLE - 20 * 86400 + 86400 * {_case([(_signal("text", p), str(n)) for p, n in L.FORESIGHT_DAYS], str(L.FORESIGHT_DEFAULT_DAYS))} AS valid_until FROM c WHERE {_signal("text", L.FORESIGHT)})
    SELECT claim_id, CASE WHEN valid_until < {AS_OF} THEN 'expired' ELSE 'pending' END AS status FROM v"""
)
def foresight_expire(spark: SparkSession, d: str) -> DataFrame:
    """Foresight noted twenty days ago."""
    noted = C.foresight(corpus.claims(spark, d).select("claim_id", "text"), AS_OF - 20 * 86400)
    return dream.expire(noted, AS_OF).select("claim_id", "status")


# --- vault and pull ---------------------------------------------------------------------


@query(f"WITH {_SOURCES} SELECT id, title, length(content[:10000]) AS stored_chars, source_type FROM s")
def source_load(spark: SparkSession, d: str) -> DataFrame:
    """C2, C3."""
    return corpus.sources(spark, d).select("id", "title", F.length(F.substring("content", 1, corpus.STORED_CHARS)).alias("stored_chars"), "source_type")


@query(
    """SELECT 'sources' AS what, count(DISTINCT id) AS n FROM vault_sources UNION ALL SELECT 'entities', count(DISTINCT id) FROM vault_entities UNION ALL SELECT 'claims', count(DISTINCT id) FROM vault_claims
    UNION ALL SELECT 'events', count(*) FROM agent_events UNION ALL SELECT 'facts', count(DISTINCT fact_id) FROM consolidated_facts"""
)
def vault_stats(spark: SparkSession, d: str) -> DataFrame:
    """C5."""
    out = None
    for what, name, key in (("sources", "vault_sources", "id"), ("entities", "vault_entities", "id"), ("claims", "vault_claims", "id"), ("events", "agent_events", None), ("facts", "consolidated_facts", "fact_id")):
        x = table(spark, d, name)
        x = x.where(F.col(key).isNotNull()).select(key).distinct() if key else x
        part = x.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN 'unchanged' WHEN doc_id % 2 = 0 THEN 'changed' ELSE 'new' END AS state FROM documents"""
)
def pull_diff(spark: SparkSession, d: str) -> DataFrame:
    """Documents against a state that knows a part of them, a part of that outdated."""
    items = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat_ws(":", F.coalesce("n_chars", F.lit(0)), "doc_id").alias("fingerprint"), "doc_id")
    state = items.where("doc_id % 3 = 0 or doc_id % 2 = 0").select(F.lit("documents").alias("adapter"), "id", F.when(F.col("doc_id") % 3 == 0, F.col("fingerprint")).otherwise("old").alias("fingerprint"))
    return pull.compare(items.select(F.lit("documents").alias("adapter"), "id", "fingerprint"), state).select("id", "state")


@query(
    """SELECT id, '# ' || trim(name) || chr(10) || 'type: ' || coalesce(entity_type, '') || chr(10) || 'sources: ' || coalesce(array_to_string(backlinks, ', '), '') AS page FROM vault_entities WHERE id IS NOT NULL AND name IS NOT NULL"""
)
def entity_pages(spark: SparkSession, d: str) -> DataFrame:
    """C4, C14."""
    e = corpus.entities(spark, d)
    return e.select("id", F.concat(F.lit("# "), "name", F.lit("\ntype: "), F.coalesce("entity_type", F.lit("")), F.lit("\nsources: "), F.coalesce(F.array_join("backlinks", ", "), F.lit(""))).alias("page"))


FLAGSHIP = bm25_topk
