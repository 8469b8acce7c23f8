"""Merging claims into each entity's current truth.

``claims`` is (claim_id, entity_id, text, tags, status, polarity, durability, confidence,
created_at, evidence array<struct<source_id, weight, ...>>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T
from recollect.operators import leader


def active(claims: DataFrame) -> DataFrame:
    """F2."""
    return claims.where("status = 'active'")


def merge_evidence(claims: DataFrame) -> DataFrame:
    """K2: (entity_id, key, claim_id, text, sources, weight, confidence): claims of equal text.

    The first claim by (created_at, claim_id) stands for all; evidence counts once per source, by
    its greatest weight.  Claims without an entity are merged among themselves.
    """
    keyed = claims.where("text is not null").withColumn("key", F.lower(T.strip(F.col("text")))).withColumn("entity_id", F.coalesce("entity_id", F.lit("")))
    first = keyed.groupBy("entity_id", "key").agg(F.min(F.struct("created_at", "claim_id", "text")).alias("f"))
    # one row per source first, so a claim with very much evidence is summed in parts
    per = keyed.select("entity_id", "key", F.explode("evidence").alias("e")).groupBy("entity_id", "key", "e.source_id").agg(F.max("e.weight").alias("w"))
    total = per.groupBy("entity_id", "key").agg(F.count("*").alias("sources"), F.round(F.sum("w"), 6).alias("weight"))
    w = F.coalesce("weight", F.lit(0.0))
    return first.join(total, ["entity_id", "key"], "left").select(
        "entity_id", "key", "f.claim_id", "f.text", F.coalesce("sources", F.lit(0)).alias("sources"), w.alias("weight"), F.round(F.least(F.lit(0.95), w / (w + 1)), 3).alias("confidence")
    )


def new_foresight(found: DataFrame, existing: DataFrame) -> DataFrame:
    """K3: foresight whose text the entity doesn't have yet; one row per (entity, text)."""
    key = lambda df: df.withColumn("key", F.lower(T.strip(F.col("text"))))
    one = key(found).dropDuplicates(["entity_id", "key"])
    return one.join(key(existing).select("entity_id", "key"), ["entity_id", "key"], "left_anti").drop("key")


def timeline(mentions: DataFrame, claims: DataFrame, sources: DataFrame, as_of: float) -> DataFrame:
    """K4: a row per (source, entity), with the number of the source's claims on the entity.

    ``mentions`` is (source_id, entity_id), ``claims`` (source_id, entity_id), ``sources`` (id, title).
    """
    n = claims.groupBy("source_id", "entity_id").agg(F.count("*").alias("n"))
    rows = mentions.select("source_id", "entity_id").distinct().join(n, ["source_id", "entity_id"], "left").join(sources.select(F.col("id").alias("source_id"), "title").dropDuplicates(["source_id"]), "source_id", "left")
    return rows.select(
        "entity_id", "source_id", F.date_format(F.timestamp_seconds(F.lit(float(as_of))), "yyyy-MM-dd").alias("date"),
        F.concat(F.lit("New evidence from: "), F.coalesce("title", F.lit(""))).alias("title"), F.concat(F.lit("Extracted "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" claims")).alias("body"),
    )


def summaries(claims: DataFrame) -> DataFrame:
    """K5: (entity_id, summary): active claims by first tag, the three surest of each.

    Ties by (created_at, claim_id).  Tags out of the order are left out; an entity that has no
    others gets its first claim.
    """
    c = active(claims).where("entity_id is not null and text is not null")
    tag = F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("other"))
    place = F.array_position(F.array(*(F.lit(t) for t in L.SUMMARY_ORDER)), F.col("tag"))
    ranked = c.withColumn("tag", tag).withColumn("place", place)
    w = Window.partitionBy("entity_id", "place").orderBy(F.col("confidence").desc_nulls_last(), "created_at", "claim_id")
    top = ranked.withColumn("n", F.row_number().over(w)).where("place > 0 and n <= 3")
    label = F.element_at(F.array(*(F.lit(x) for x in L.SUMMARY_LABELS)), F.col("place").cast("int"))
    parts = top.groupBy("entity_id", "place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.substring("text", 1, 120).alias("t")))), lambda x: x["t"]), "; ").alias("items"))
    joined = parts.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("place", F.concat(F.lit("["), label, F.lit("] "), "items").alias("p")))).alias("ps"))
    joined = joined.select("entity_id", F.array_join(F.transform("ps", lambda x: x["p"]), " | ").alias("summary"))
    first = c.groupBy("entity_id").agg(F.min(F.struct("created_at", "claim_id", F.substring("text", 1, 200).alias("t")))["t"].alias("first"))
    return first.join(joined, "entity_id", "left").select("entity_id", F.coalesce("summary", "first").alias("summary"))


def consolidate(facts: DataFrame, threshold: float = L.SAME_FACT) -> DataFrame:
    """K6: (id, leader, weight): newest first, each survivor absorbs later items like it.

    ``facts`` is (id, grp, text, timestamp).  Ties by id, greatest first.
    """
    items = facts.select("id", "grp", T.jaccard_tokens(F.coalesce("text", F.lit(""))).alias("tokens"), (-F.coalesce("timestamp", F.lit(0.0))).alias("t"))
    led = leader.cluster(items, threshold, [F.col("t")])
    return led.withColumn("weight", F.when(F.col("id") == F.col("leader"), F.lit(1.0)).otherwise(F.lit(L.ABSORBED_WEIGHT)))


def supersede(claims: DataFrame) -> DataFrame:
    """K7, K8: (claim_id, status) of active claims after both phases, within each entity.

    First, claims absorbed by a newer one at 0.6 are superseded; of those that stay, newest
    first, one is superseded by a newer at 0.5 if either of the two is temporary.
    """
    c = active(claims).where("entity_id is not null and text is not null").select("claim_id", "entity_id", "text", "created_at", "durability")
    first = consolidate(c.select(F.col("claim_id").alias("id"), F.col("entity_id").alias("grp"), "text", F.col("created_at").alias("timestamp")))
    kept = c.join(first.where("id = leader").select(F.col("id").alias("claim_id")), "claim_id", "left_semi")
    items = kept.select(F.col("claim_id").alias("id"), F.col("entity_id").alias("grp"), T.jaccard_tokens(F.col("text")).alias("tokens"))
    temporary = kept.where("durability = 'temporary'").select("claim_id")
    pairs = leader.similar_pairs(items, L.SAME_TEMPORARY)
    ta, tb = temporary.select(F.col("claim_id").alias("a"), F.lit(True).alias("ta")), temporary.select(F.col("claim_id").alias("b"), F.lit(True).alias("tb"))
    pairs = pairs.join(ta, "a", "left").join(tb, "b", "left").where("ta or tb")
    led = leader.lead(kept.select(F.col("claim_id").alias("id"), F.struct((-F.coalesce("created_at", F.lit(0.0))).alias("t"), "claim_id").alias("ord")), pairs)
    stay = led.where("id = leader").select(F.col("id").alias("claim_id"), F.lit("active").alias("status"))
    return c.select("claim_id").join(stay, "claim_id", "left").select("claim_id", F.coalesce("status", F.lit("superseded")).alias("status"))


def opposed(claims: DataFrame) -> DataFrame:
    """K9: (entity_id, claim_id, text, confidence, p): the active claims that take a side, surer than 0.5.

    A neutral polarity is read from the text.
    """
    c = active(claims).where("entity_id is not null and text is not null and confidence > 0.5")
    pol = F.when(F.coalesce("polarity", F.lit("neutral")) != "neutral", F.col("polarity")).otherwise(T.polarity(F.col("text")))
    return c.select("entity_id", "claim_id", "text", "confidence", pol.alias("p")).where("p in ('positive', 'negative')")


def contradictions(claims: DataFrame) -> DataFrame:
    """K9: (entity_id, positives, negatives): active claims of an entity with opposite polarity.

    Contradicting pairs are all pairs across the two sides, so the sides are returned
    and not the pairs; ``pairs`` counts them.
    """
    sides = opposed(claims).groupBy("entity_id").agg(F.count_if(F.col("p") == "positive").alias("positives"), F.count_if(F.col("p") == "negative").alias("negatives"))
    return sides.where("positives > 0 and negatives > 0").withColumn("pairs", F.col("positives") * F.col("negatives"))


def contradicting_pairs(claims: DataFrame) -> DataFrame:
    """K9 in pairs, (entity_id, claim_a, claim_b), for a report on chosen entities."""
    sides = opposed(claims)
    a = sides.where("p = 'positive'").select("entity_id", F.col("claim_id").alias("x"))
    b = sides.where("p = 'negative'").select("entity_id", F.col("claim_id").alias("y"))
    return a.join(b, "entity_id").select("entity_id", F.least("x", "y").alias("claim_a"), F.greatest("x", "y").alias("claim_b"))
