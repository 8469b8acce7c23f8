"""The driver's queries of this sub-package: ``QUERIES`` and, where SQL can say it, ``ORACLES``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import bpe, consensus, conversations, mixture, pii, ranking, residue, secrets, truncation
from recollect.session import spread
from recollect.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each record and kind of personal information in it."""
    persons = pii.known_persons(table(spark, d, "vault_entities"))
    return pii.found_kinds(pii.texts(spread(table(spark, d, "agent_events")), table(spark, d, "vault_sources"), table(spark, d, "vault_claims")), persons)


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The same records' texts with typed placeholders."""
    persons = pii.known_persons(table(spark, d, "vault_entities"))
    texts = pii.texts(spread(table(spark, d, "agent_events")), table(spark, d, "vault_sources"), table(spark, d, "vault_claims"))
    return pii.redact(texts, ["rel", "row_key"], "text", persons)


def p2_method(spark: SparkSession, d: str) -> DataFrame:
    """The aligned consensus of the records that name the same things, and the record closest to it."""
    return consensus.consensus(table(spark, d, "consolidated_facts"), table(spark, d, "vault_claims")).drop("group")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The survivor of each group of duplicate facts."""
    return consensus.survivors(table(spark, d, "consolidated_facts"), table(spark, d, "vault_claims")).select("fact_id")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Survivors with the voted text and how far they are from the consensus."""
    return consensus.survivors(table(spark, d, "consolidated_facts"), table(spark, d, "vault_claims")).drop("group")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fuse(ranking.all_scores(table(spark, d, "search_results"), table(spark, d, "dream_candidates")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each query."""
    return ranking.best_pages(_fused(spark, d)).select("query_id", "id")


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All pages of each query in order."""
    return ranking.ranks(_fused(spark, d)).select("query_id", "rank", "id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The fields that hold a credential."""
    fields = secrets.event_fields(spread(table(spark, d, "agent_events"))).unionByName(secrets.change_fields(table(spark, d, "umsf_raw")))
    return secrets.fields_with_credentials(fields)


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The same fields' texts, redacted."""
    fields = secrets.event_fields(spread(table(spark, d, "agent_events"))).unionByName(secrets.change_fields(table(spark, d, "umsf_raw")))
    return secrets.redact_fields(fields)


def p5_method(spark: SparkSession, d: str) -> DataFrame:
    """The conversations that the overlap graph of export fragments merges without a gap."""
    return conversations.merged(table(spark, d, "agent_events"))


def p5_fragments(spark: SparkSession, d: str) -> DataFrame:
    """What the overlap graph says of each session."""
    return conversations.assemble(table(spark, d, "agent_events"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The sessions to drop."""
    return conversations.judge(table(spark, d, "agent_events")).where("broken").select("session_id")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The messages of the other sessions, in order, with speakers."""
    return conversations.turns(table(spark, d, "agent_events"))


def p6_method(spark: SparkSession, d: str) -> DataFrame:
    """The candidate limits of each agent and of the claim store, with their censoring posteriors."""
    return truncation.censored(spread(table(spark, d, "agent_events")), table(spark, d, "vault_claims"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The records whose text was cut."""
    return truncation.cut_records(spread(table(spark, d, "agent_events")), table(spark, d, "vault_claims"))


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each agent and the claim store cut."""
    return truncation.rates(spread(table(spark, d, "agent_events")), table(spark, d, "vault_claims"))


def p6_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often the records of each source are cut."""
    return truncation.rates(spread(table(spark, d, "agent_events")), table(spark, d, "vault_claims"), "source")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Each document's token ids."""
    return bpe.encode_corpus(spread(table(spark, d, "documents")))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture, with the pass and the tokens taken."""
    return mixture.mix(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Asked and actual shares of the sources."""
    return mixture.shares(p9_mixture(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold residue."""
    return residue.residue(spread(table(spark, d, "documents"))).select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents without."""
    return residue.clean(spread(table(spark, d, "documents"))).select("doc_id", "source", "text")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_redacted, p2_method, p2_found, p2_survivors, p3_found, p3_ranking, p4_found, p4_redacted, p5_method, p5_found, p5_fragments, p5_conversations,
        p6_method, p6_found, p6_rates, p6_source_rates, p8_ids, p9_mixture, p9_shares, p10_found, p10_clean,
    )
}

_FACT_WORDS = r"""regexp_extract_all(lower(translate(fact, '{wide}', '{narrow}')), '[\p{{L}}\p{{M}}\p{{N}}]+')""".format(
    wide="".join(chr(c) for c in range(0xFF01, 0xFF5F) if c != 0xFF07), narrow="".join(chr(c) for c in range(0x21, 0x7F) if c != 0x27)
)

#: r (query_id, id, k): all pages of each query in order.
_RANKED = """
        WITH s AS (
          SELECT query_id, list_name, id, max(CASE WHEN NOT isnan(score) THEN score END) AS score FROM search_results
          WHERE query_id IS NOT NULL AND id IS NOT NULL AND list_name IS NOT NULL GROUP BY ALL),
        x AS (
          SELECT * FROM s UNION ALL
          SELECT query_id, 'dream', p.id, score FROM (SELECT DISTINCT query_id, id FROM s) p
          JOIN (SELECT source_id AS id, max(score) AS score FROM dream_candidates WHERE NOT isnan(score) GROUP BY 1) USING (id)),
        m AS (SELECT query_id, list_name, quantile_disc(score, 0.5) AS med FROM x WHERE score IS NOT NULL GROUP BY ALL),
        o AS (
          SELECT query_id, list_name, any_value(med) AS med, quantile_disc(abs(score - med), 0.5) AS mad, avg(abs(score - med)) AS mean, min(score) AS least
          FROM x JOIN m USING (query_id, list_name) WHERE score IS NOT NULL GROUP BY ALL),
        z AS (SELECT *, CASE WHEN mad > 0 THEN mad * 1.4826 WHEN mean > 0 THEN mean ELSE 1 END AS scale FROM o),
        b AS (SELECT *, ln(0.25 + 0.75 / (1 + exp(-greatest(-60, least(60, (least - med) / scale))))) - ln(2) AS floor FROM z),
        t AS (SELECT query_id, sum(floor) AS floors, count(*) AS n FROM b GROUP BY 1),
        v AS (
          SELECT query_id, id, sum(CASE WHEN score IS NULL OR med IS NULL THEN 0 ELSE ln(0.25 + 0.75 / (1 + exp(-greatest(-60, least(60, (score - med) / scale))))) - floor END) AS gain
          FROM x LEFT JOIN b USING (query_id, list_name) GROUP BY ALL),
        r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(exp((floors + gain) / n), 9) DESC, id) AS k FROM v JOIN t USING (query_id))"""

#: w: the messages with their speakers, b: the sessions to drop.
_JUDGED = r"""
        WITH e AS (SELECT * FROM agent_events WHERE session_id IS NOT NULL AND session_id <> ''),
        m AS (
          SELECT session_id, ts, role, content, min(id) AS id FROM e
          WHERE "type" = 'message' AND regexp_matches(content, '[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') GROUP BY ALL),
        w AS (
          SELECT session_id, CASE WHEN ts >= 1e11 THEN ts / 1000 ELSE ts END AS t, id, role, content,
            CASE WHEN role IS NULL OR trim(role) = '' THEN 'none' WHEN lower(trim(role)) IN ('user', 'human') THEN 'user'
                 WHEN lower(trim(role)) IN ('assistant', 'ai', 'model') THEN 'assistant' ELSE 'other' END AS who FROM m),
        k AS (
          SELECT *, lead(who) OVER (PARTITION BY session_id ORDER BY t NULLS FIRST, id) AS nxt, row_number() OVER (PARTITION BY session_id ORDER BY t NULLS FIRST, id) AS n
          FROM w WHERE who IN ('user', 'assistant')),
        b AS (
          SELECT session_id FROM w WHERE who = 'none'
          UNION SELECT session_id FROM k WHERE n = 1 AND who = 'assistant'
          UNION SELECT session_id FROM k WHERE who = 'user' AND (nxt IS NULL OR nxt = 'user')
          UNION SELECT session_id FROM e WHERE session_id NOT IN (SELECT session_id FROM w WHERE who = 'user')
          UNION SELECT session_id FROM e WHERE session_id NOT IN (SELECT session_id FROM w WHERE who = 'assistant'))"""

ORACLES: dict[str, str] = {
    "p2_found": f"""
        WITH f AS (
          SELECT DISTINCT fact_id, array_to_string({_FACT_WORDS}, ' ') AS k,
            (coalesce(len(entities) > 0, false))::int + (coalesce(source <> '', false))::int + ("timestamp" IS NOT NULL)::int
              + (coalesce(supersedes <> '', false))::int + (weight IS NOT NULL)::int + (coalesce(claim_id <> '', false))::int AS filled,
            coalesce("timestamp", -1e300) AS t, coalesce(weight, -1e300) AS w, coalesce(c.confidence, -1e300) AS conf
          FROM consolidated_facts LEFT JOIN (SELECT id, max(confidence) AS confidence FROM vault_claims GROUP BY id) c ON c.id = claim_id
          WHERE fact_id IS NOT NULL AND fact IS NOT NULL),
        g AS (SELECT k, max(filled) AS a, max(t) AS b, max(w) AS c, max(conf) AS d FROM f WHERE k <> '' GROUP BY k HAVING count(DISTINCT fact_id) > 1)
        SELECT fact_id FROM f JOIN g USING (k) WHERE filled = a AND t = b AND w = c AND conf = d
        """,
    "p3_found": f"{_RANKED} SELECT query_id, id FROM r WHERE k = 1",
    "p3_ranking": f"{_RANKED} SELECT query_id, k::INT AS rank, id FROM r",
    "p5_found": f"{_JUDGED} SELECT DISTINCT session_id FROM b",
    "p5_conversations": f"""{_JUDGED}
        SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t NULLS FIRST, id) AS turn, CASE WHEN who = 'other' THEN lower(trim(role)) ELSE who END AS speaker, t AS ts, content
        FROM w WHERE session_id NOT IN (SELECT session_id FROM b)""",
}
