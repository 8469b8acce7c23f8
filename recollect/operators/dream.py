"""The offline consolidation cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T
from recollect.operators import claims as C
from recollect.operators import leader


def light(sources: DataFrame, as_of: float, hours: float = 24.0) -> DataFrame:
    """Candidates from the sources taken in during the last hours.

    Without a time window, ``hours=0``, all sources count.
    """
    recent = sources if not hours else sources.where(F.col("ingested_at") >= float(as_of) - float(hours) * 3600)
    found = C.extract(recent.dropDuplicates(["id"]).select("id", "content", "ingested_at"))
    return found.select(C.claim_id(F.col("id"), F.col("ordinal").cast("string"), F.col("text")).alias("claim_id"), F.col("id").alias("source_id"), "ordinal", "text", "tag", "durability", "weight")


def expire(foresight: DataFrame, as_of: float) -> DataFrame:
    """Pending foresight past its time is expired."""
    late = (F.col("status") == "pending") & (F.col("valid_until") > 0) & (F.col("valid_until") < float(as_of))
    return foresight.withColumn("status", F.when(late, "expired").otherwise(F.col("status")))


def clusters(items: DataFrame, order: list[Column]) -> DataFrame:
    """D3: (claim_id, leader, size): greedy clusters by likeness to the leader only."""
    sets = items.select(F.col("claim_id").alias("id"), F.lit("").alias("grp"), T.jaccard_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), *order)
    led = leader.cluster(sets, L.DREAM_CLUSTER, [F.col(c) for c in sets.columns[3:]])
    sizes = led.groupBy("leader").agg(F.count("*").alias("size"))
    return led.join(sizes, "leader").select(F.col("id").alias("claim_id"), "leader", "size")


def across(clustered: DataFrame, claims: DataFrame) -> DataFrame:
    """D3: (entity_id): entities with claims in more than one cluster."""
    both = clustered.join(claims.where("entity_id is not null").select("claim_id", "entity_id"), "claim_id").select("entity_id", "leader").distinct()
    return both.groupBy("entity_id").agg(F.count("*").alias("n")).where("n > 1").select("entity_id")


def score(candidates: DataFrame, as_of: float, linked: bool = True) -> DataFrame:
    """Candidates with ``score`` and ``promoted``.

    ``candidates`` has (evidence_count, source_count, cluster_size, tags, durability,
    created_at, entity_id, crosses, text).  With ``linked=False`` no entity counts.
    """
    c = F.col
    base = F.least(F.lit(1.0), c("evidence_count") / 3.0)
    frequency = F.least(F.lit(1.0), base + F.least(F.lit(0.3), (F.coalesce("cluster_size", F.lit(1)) - 1) * 0.1))
    relevance = F.lit(L.DREAM_OTHER_RELEVANCE)
    for tag, value in reversed(L.DREAM_RELEVANCE):
        relevance = F.when(F.coalesce(F.array_contains("tags", tag), F.lit(False)), value).otherwise(relevance)
    diversity = F.least(F.lit(1.0), c("source_count") / 2.0)
    half = F.lit(L.DREAM_OTHER_HALF_LIFE)
    for kind, days in L.DREAM_HALF_LIFE.items():
        half = F.when(c("durability") == kind, days).otherwise(half)
    recency = F.pow(F.lit(2.0), -((F.lit(float(as_of)) - c("created_at")) / 86400.0) / half)
    has = c("entity_id").isNotNull() if linked else F.lit(False)
    consolidation = F.when(has, 0.7).otherwise(0.2)
    rich = F.least(F.lit(1.0), F.length("text") / 100.0)
    richness = F.when(has & F.coalesce(c("crosses"), F.lit(False)), F.least(F.lit(1.0), rich + 0.3)).otherwise(rich)
    parts = {"frequency": frequency, "relevance": relevance, "diversity": diversity, "recency": recency, "consolidation": consolidation, "richness": richness}
    total = sum((parts[k] * w for k, w in L.DREAM_WEIGHTS.items()), F.lit(0.0))
    return candidates.withColumn("score", F.round(total, 6)).withColumn("promoted", F.col("score") >= L.DREAM_PROMOTE)


def report(scored: DataFrame) -> DataFrame:
    """One row of counters."""
    return scored.agg(
        F.count("*").alias("candidates"), F.count_if("promoted").alias("promoted"), F.count_if(~F.col("promoted")).alias("discarded"), F.round(F.avg("score"), 4).alias("mean_score")
    )


def details(scored: DataFrame) -> DataFrame:
    """The promoted claims, shortened."""
    return scored.where("promoted").select("claim_id", F.substring("text", 1, 100).alias("claim"), F.round("score", 3).alias("score"))
