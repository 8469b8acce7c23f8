"""Queries of single operators that no composed query shows, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T
from recollect.operators import claims as C
from recollect.operators import entities, evaluate, retrieval, truth
from recollect.plans import corpus
from recollect.plans.queries import _BM25, _CLAIMS, _TYPED, AS_OF, _candidates_sql, _polarity, _rerank_tokens, _signal, _strip, _suffix, _tokens, query
from recollect.sources import files, glossary
from recollect.sources.tables import table

# --- text -------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_rerank_tokens('text')} AS tokens FROM documents WHERE text IS NOT NULL")
def rerank_tokens(spark: SparkSession, d: str) -> DataFrame:
    """T2."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.rerank_tokens(F.col("text")).alias("tokens"))


_SPACED = r"regexp_replace(regexp_replace({}, '([\x{{4e00}}-\x{{9fff}}])\s+([a-zA-Z0-9])', '\1\2', 'g'), '([a-zA-Z0-9])\s+([\x{{4e00}}-\x{{9fff}}])', '\1\2', 'g')"


@query(f"SELECT doc_id, {_SPACED.format('text')} AS text FROM documents WHERE text IS NOT NULL")
def space_scripts(spark: SparkSession, d: str) -> DataFrame:
    """T17."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.space_scripts(F.col("text")).alias("text"))


def _cut_sql(start: str, end: str) -> str:
    body = _strip(f"replace(substr(text, ({start}) + 1, ({end}) - ({start})), chr(10), ' ')")
    return f"CASE WHEN {start} > 0 THEN '…' ELSE '' END || {body} || CASE WHEN {end} < n THEN '…' ELSE '' END"


@query(
    rf"""WITH t AS (SELECT doc_id, text, lower(text) AS low, length(text) AS n, regexp_extract_all(text, '\S+')[9] AS w FROM documents WHERE text IS NOT NULL),
    u AS (SELECT *, coalesce(list_min(list_filter(list_transform({_tokens("coalesce(w, '')")}, lambda k: instr(low, k)), lambda p: p > 0)) - 1, n) AS hit, instr(low, lower(coalesce(w, ''))) - 1 AS spot FROM t),
    v AS (SELECT *, greatest(0, hit - 50) AS s1, greatest(0, spot - 80) AS s2 FROM u)
    SELECT doc_id, {_cut_sql("s1", "least(n, s1 + 200)")} AS found, CASE WHEN coalesce(w, '') = '' THEN NULL ELSE {_cut_sql("s2", "least(n, spot + length(w) + 120)")} END AS exact FROM v"""
)
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Each document around its ninth word."""
    word = F.coalesce(F.try_element_at(T.all_matches(F.col("text"), r"\S+"), F.lit(9)), F.lit(""))
    x = table(spark, d, "documents").where("text is not null").withColumn("w", word)
    return x.select("doc_id", T.bm25_snippet(F.col("text"), T.bm25_tokens(F.col("w"))).alias("found"), F.when(F.col("w") != "", T.exact_snippet(F.col("text"), F.col("w"))).alias("exact"))


# --- entities ---------------------------------------------------------------------------

#: A vault's own patterns and names, as it would write them.
GLOSSARY = "entities:\n  - Kestrel\n  - Millrace\n  - 检索索引\npatterns:\n  component:\n    - 'the ((?:claim|entity|rank|pull) [a-z]+)'\n    - '([a-z]+_queue)'\n"
_PATTERNS, _NAMES = glossary.parse(GLOSSARY)


@query(
    f"""WITH {_TYPED}, own AS (SELECT id, {_strip("name")} AS name, arg_min(type, rank) AS type FROM (
      {" UNION ALL ".join(f"SELECT id, {i} AS rank, '{t}' AS type, unnest(regexp_extract_all(content, '(?i){p}', 1)) AS name FROM tx" for t, ps in _PATTERNS.items() for i, p in enumerate(ps))}) WHERE length({_strip("name")}) >= 2 GROUP BY 1, 2),
    ca AS ({_candidates_sql()}), al AS (SELECT id, name, type, 0 AS p FROM ty UNION ALL SELECT id, name, type, 0 FROM own WHERE (id, name) NOT IN (SELECT id, name FROM ty)
      UNION ALL SELECT id, name, {_suffix("name")}, 1 FROM tx, (SELECT unnest({_NAMES!r}) AS name) WHERE contains(content, name) UNION ALL SELECT id, name, {_suffix("name")}, 2 FROM ca)
    SELECT id, name, arg_min(type, p) AS type FROM al GROUP BY 1, 2"""
)
def entity_glossary(spark: SparkSession, d: str) -> DataFrame:
    """Extraction with a vault's own patterns and names."""
    return entities.extract(corpus.sources(spark, d), extra_patterns=_PATTERNS, extra_names=_NAMES)


# --- transcripts ------------------------------------------------------------------------


@query(
    f"""WITH m AS (SELECT id AS line, session_id, role, {_strip("content")} AS said FROM agent_events WHERE "type" = 'message' AND role IN ('user', 'assistant') AND content IS NOT NULL)
    SELECT line, 0 AS block, session_id, 'message' AS type, role, CASE WHEN length(said) > 1500 THEN said[:1499] || '…' ELSE said END AS content FROM m WHERE said <> ''"""
)
def transcript_messages(spark: SparkSession, d: str) -> DataFrame:
    """C11: the event table's messages written as transcript rows and read back."""
    e = table(spark, d, "agent_events").where("type = 'message'")
    row = F.struct(F.col("role").alias("type"), F.col("session_id").alias("sessionId"), F.struct("role", "content").alias("message"))
    lines = e.select(F.lit("agent_events").alias("path"), F.col("id").alias("line"), F.to_json(row).alias("value"))
    return files.transcript_events(lines).select("line", "block", "session_id", "type", "role", "content")


# --- claims -----------------------------------------------------------------------------


@query(
    f"""WITH {_CLAIMS}, f AS (SELECT coalesce(entity_id, '') AS entity_id, lower({_strip("text[:500]")}) AS key, created_at FROM c WHERE {_signal("text", L.FORESIGHT)})
    SELECT DISTINCT entity_id, key FROM f WHERE created_at >= {AS_OF} - 90 * 86400 AND (entity_id, key) NOT IN (SELECT entity_id, key FROM f WHERE created_at < {AS_OF} - 90 * 86400)"""
)
def foresight_append(spark: SparkSession, d: str) -> DataFrame:
    """K3: the foresight of the last ninety days that the entities did not have before."""
    c = corpus.claims(spark, d).where("created_at is not null").withColumn("entity_id", F.coalesce("entity_id", F.lit("")))
    noted = C.foresight(c.select("claim_id", "entity_id", "text", "created_at"), AS_OF)
    late = F.col("created_at") >= AS_OF - 90 * 86400
    kept = c.select("claim_id", "entity_id", "created_at").join(noted.select("claim_id", "text"), "claim_id")
    new = truth.new_foresight(kept.where(late).select("entity_id", "text"), kept.where(~late).select("entity_id", "text"))
    return new.select("entity_id", F.lower(T.strip(F.col("text"))).alias("key"))


@query(
    f"""WITH {_CLAIMS}, x AS (SELECT entity_id, claim_id, CASE WHEN coalesce(polarity, 'neutral') <> 'neutral' THEN polarity ELSE {_polarity("text")} END AS p
      FROM c WHERE status = 'active' AND entity_id IS NOT NULL AND text IS NOT NULL AND confidence > 0.5)
    SELECT entity_id, claim_id, p AS side FROM x WHERE p IN ('positive', 'negative') AND entity_id IN (SELECT entity_id FROM x WHERE p IN ('positive', 'negative') GROUP BY 1 HAVING count(DISTINCT p) = 2)"""
)
def contradiction_sides(spark: SparkSession, d: str) -> DataFrame:
    """The claims that contradict others, by the side they take; each contradicts all of the other side."""
    c = corpus.claims(spark, d)
    both = truth.contradictions(c).select("entity_id")
    return truth.opposed(c).join(both, "entity_id", "left_semi").select("entity_id", "claim_id", F.col("p").alias("side"))


# --- evaluation -------------------------------------------------------------------------

_LONG = r"list_distinct(list_filter(regexp_extract_all(lower({}), '\w+'), lambda w: length(w) > 3))"


@query(
    rf"""WITH {_BM25}, h AS (SELECT query_id, min(CASE WHEN doc_id = query_id THEN rank END) AS hit FROM qq LEFT JOIN (SELECT * FROM bm WHERE rank <= 20) b USING (query_id) GROUP BY 1),
    g AS (SELECT query_id, query, hit, vault_path AS path, len(list_intersect({_LONG.format("query")}, {_LONG.format("coalesce(vault_path, '')")})) AS shared FROM h JOIN qq USING (query_id) JOIN documents ON doc_id = query_id)
    SELECT query_id, hit, len(list_filter(regexp_extract_all(query, '\S+')[1:3], lambda k: contains(lower({_SPACED.format("coalesce(path, '')")}), lower({_SPACED.format("k")})))) > 0 AS keyword,
      CASE WHEN hit <= 5 THEN 'hit' WHEN hit IS NOT NULL THEN 'ranked_low' WHEN shared = 0 THEN 'no_overlap' WHEN shared < 3 THEN 'weak_overlap' ELSE 'missed' END AS kind FROM g"""
)
def retrieval_failures(spark: SparkSession, d: str) -> DataFrame:
    """What became of each query, and whether its first words stand in its document's path."""
    q = corpus.document_queries(spark, d)
    ranked = retrieval.bm25(corpus.documents_index(spark, d), q, 20)
    hits = evaluate.hit_ranks(ranked, q.select("query_id", F.col("query_id").alias("doc_id")), q)
    x = hits.join(q, "query_id").join(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.coalesce("vault_path", F.lit("")).alias("path")), "query_id")
    words = F.slice(T.all_matches(F.col("query"), r"\S+"), 1, 3)
    overlap = evaluate.long_word_overlap(F.col("query"), F.col("path"))
    return x.select("query_id", "hit", evaluate.keyword_hit(words, F.col("path")).alias("keyword"), evaluate.failure_kind(F.col("hit"), overlap).alias("kind"))


@query(
    f"""WITH {_BM25}, h AS (SELECT query_id, min(CASE WHEN doc_id = query_id THEN rank END) AS hit FROM qq LEFT JOIN (SELECT * FROM bm WHERE rank <= 20) b USING (query_id) GROUP BY 1),
    g AS (SELECT coalesce(lang, '') AS lang, hit FROM h JOIN documents ON doc_id = query_id)
    SELECT lang, count(*) AS queries, round(avg((coalesce(hit <= 1, false))::int), 4) AS recall_1, round(avg((coalesce(hit <= 5, false))::int), 4) AS recall_5, round(avg((coalesce(hit <= 10, false))::int), 4) AS recall_10,
      round(avg((coalesce(hit <= 20, false))::int), 4) AS recall_20, round(avg(coalesce(1.0 / hit, 0)), 4) AS mrr, round(avg(CASE WHEN hit <= 10 THEN 1.0 / log2(hit + 1) ELSE 0 END), 4) AS ndcg_10 FROM g GROUP BY 1"""
)
def retrieval_metrics_by(spark: SparkSession, d: str) -> DataFrame:
    """B2 by the documents' language."""
    q = corpus.document_queries(spark, d)
    ranked = retrieval.bm25(corpus.documents_index(spark, d), q, 20)
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.coalesce("lang", F.lit("")).alias("lang"))
    return evaluate.metrics(evaluate.hit_ranks(ranked, q.select("query_id", F.col("query_id").alias("doc_id")), q).join(lang, "query_id"), by="lang")


@query("SELECT doc_id AS question_id, source AS question_type FROM documents WHERE lang IS NOT NULL ORDER BY doc_id LIMIT 50")
def question_sample(spark: SparkSession, d: str) -> DataFrame:
    """the first fifty questions that have an answer; here one of each document, with none where the language is unknown."""
    kind = F.when(F.col("lang").isNull(), evaluate.ABSTENTION).otherwise(F.col("source"))
    return evaluate.answerable(table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), kind.alias("question_type")), first=50)
