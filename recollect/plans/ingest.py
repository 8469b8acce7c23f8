"""Taking texts and event documents into a vault, one batch at a time."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import claims as C
from recollect.operators import dream, entities, events, hooks, truth, umsf
from recollect.session import cut_lineage
from recollect.sources import glossary
from recollect.sources.vault import Vault


def texts(vault: Vault, docs: DataFrame, as_of: float | None = None) -> DataFrame:
    """K1: take in documents (title, content, source_type) and return their sources.

    Sources get ids of their content, so a text that comes again changes nothing but its
    time.  Null and blank contents are dropped.
    """
    now = float(as_of if as_of is not None else time.time())
    patterns, names = glossary.load(f"{vault.root}/.entities.yaml")
    col = lambda c, other: F.coalesce(F.col(c), other) if c in docs.columns else other
    title = col("title", F.lit(""))
    new = docs.where(T.strip(F.coalesce("content", F.lit(""))) != "").select(
        C.claim_id(F.col("content")).alias("id"), F.when(title != "", title).otherwise(T.title_of(F.col("content"))).alias("title"), "content",
        col("source_type", F.lit("text")).alias("source_type"), F.lit(now).alias("ingested_at"), col("umsf", F.lit(None).cast("string")).alias("umsf"),
    ).dropDuplicates(["id"])
    new = cut_lineage(new)
    claims = cut_lineage(C.extract(new).withColumn("claim_id", C.claim_id(F.col("id"), F.col("ordinal").cast("string"), F.col("text"))))
    found = cut_lineage(entities.extract(new, extra_patterns=patterns or None, extra_names=names or None))
    known = vault.load("entities")
    resolved = cut_lineage(entities.resolve(found, known))
    mentions = cut_lineage(found.join(resolved, "name").select(F.col("id").alias("source_id"), "entity_id", "name", "type", "is_new"))
    linked = entities.link(claims.select(F.col("id").alias("source_id"), "claim_id", "text"), mentions.select("source_id", "entity_id", "name"), ["source_id"])
    evidence = F.array(
        F.struct(
            C.claim_id(F.lit("e"), F.col("claim_id")).alias("id"), F.col("id").alias("source_id"), F.col("text").alias("text"), F.col("weight").alias("weight"),
            F.lit(now).alias("timestamp"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("lines"),
        )
    )
    tags = F.when(F.col("tag").isNotNull(), F.array("tag")).otherwise(F.array().cast("array<string>"))
    rows = claims.join(linked, "claim_id", "left").select(
        F.col("claim_id").alias("id"), "text", "confidence", F.lit("active").alias("status"), "polarity", evidence.alias("evidence"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
        "entity_id", tags.alias("tags"), "durability",
    )
    vault.save("claims", cut_lineage(rows))
    _update_truth(vault, mentions, new, now)
    kept = claims.groupBy("id").agg(F.sort_array(F.collect_list("claim_id")).alias("claims_extracted"))
    named = mentions.groupBy(F.col("source_id").alias("id")).agg(F.sort_array(F.collect_set("entity_id")).alias("entities_extracted"))
    out = cut_lineage(new.join(kept, "id", "left").join(named, "id", "left"))
    vault.save("sources", out)
    return out


def as_truth(claims: DataFrame) -> DataFrame:
    """Stored claims with the key that ``truth`` uses."""
    return claims.withColumnRenamed("id", "claim_id")


def _update_truth(vault: Vault, mentions: DataFrame, new: DataFrame, now: float) -> None:
    """K2 to K8 for the entities that the batch mentions."""
    touched = mentions.select(F.col("entity_id").alias("id")).distinct()
    stored = vault.load("claims")
    mine = cut_lineage(stored.join(touched.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi"))
    verdict = truth.supersede(as_truth(mine)).where("status = 'superseded'").select(F.col("claim_id").alias("id"), F.lit(now).alias("at"))
    older = cut_lineage(mine.join(verdict, "id").withColumn("status", F.lit("superseded")).withColumn("updated_at", F.col("at")).drop("at"))
    vault.save("claims", older)
    # claims of equal text are one: later ones lend their evidence to the first
    live = cut_lineage(as_truth(vault.load("claims").join(touched.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi")))
    summary = truth.summaries(live).withColumnRenamed("entity_id", "id")
    links = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.collect_set("source_id").alias("more"), F.min(F.struct((-F.length("name")).alias("l"), "name", "type")).alias("n"))
    known = vault.load("entities").select("id", "name", "aliases", "entity_type", "backlinks", "created_at")
    rows = links.join(known, "id", "left").join(summary, "id", "left").select(
        "id", F.coalesce("name", "n.name").alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("entity_type", "n.type").alias("entity_type"),
        F.array_union(F.coalesce("backlinks", F.array().cast("array<string>")), "more").alias("backlinks"), F.coalesce("created_at", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"), "summary",
    )
    vault.save("entities", cut_lineage(rows))
    on = live.select("entity_id", F.explode("evidence.source_id").alias("source_id"))
    lines = truth.timeline(mentions, on, new, now).withColumn("id", C.claim_id(F.col("entity_id"), F.col("source_id"))).withColumn("timestamp", F.lit(now))
    vault.save("timeline", cut_lineage(lines))
    ahead = C.foresight(live.where("status = 'active' and entity_id is not null").select("entity_id", "text"), now)
    fresh = truth.new_foresight(ahead, vault.load("foresight"))
    vault.save("foresight", cut_lineage(fresh.withColumn("id", C.claim_id(F.col("entity_id"), F.col("text")))))


def documents(vault: Vault, raw: DataFrame, key: str = "umsf_id", payload: str = "payload", as_of: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted documents with their events, fired hook rows) of event documents.

    Valid documents are rendered and compiled, their events appended, hooks fire on them;
    rejected ones are left out.
    """
    accepted, _ = umsf.validate(umsf.parse(raw, key, payload))
    accepted = cut_lineage(accepted)
    rendered = umsf.render(accepted, key).join(raw.select(key, F.col(payload).alias("umsf")), key).join(accepted.select(key, "source_type"), key)
    content = rendered.where("markdown <> ''").select(F.lit("").alias("title"), F.col("markdown").alias("content"), "source_type", "umsf")
    texts(vault, content, as_of)
    ids = rendered.select(key, C.claim_id(F.col("markdown")).alias("source_id"))
    rows = events.append_rows(accepted.join(ids, key, "left").select("source_id", "session_id", "agent", "events"))
    rows = cut_lineage(rows.withColumn("id", F.sha2(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in rows.columns)), 256)))
    vault.save("events", rows)
    return accepted, hooks.Registry().fire(rows)


def dream_cycle(vault: Vault, hours: float = 24.0, as_of: float | None = None) -> dict:
    """D1 to D6 over a vault; returns the report."""
    started = time.time()
    now = float(as_of if as_of is not None else started)
    expired = dream.expire(vault.load("foresight"), now).where("status = 'expired'")
    vault.save("foresight", cut_lineage(expired))
    recent = vault.load("sources").where(F.col("ingested_at") >= now - hours * 3600).select(F.col("id").alias("source_id"))
    claims = vault.load("claims").where("status = 'active'")
    of_recent = claims.select("id", F.explode("evidence.source_id").alias("source_id")).join(recent, "source_id", "left_semi").select("id").distinct()
    c = cut_lineage(as_truth(claims.join(of_recent, "id", "left_semi")))
    clustered = cut_lineage(dream.clusters(c.select("claim_id", "text", "created_at"), [F.col("created_at")]))
    crossing = dream.across(clustered, c).withColumn("crosses", F.lit(True))
    candidates = c.join(clustered, "claim_id", "left").join(crossing, "entity_id", "left").select(
        "claim_id", "text", "tags", "durability", "created_at", "entity_id", "crosses", F.size("evidence").alias("evidence_count"),
        F.size(F.array_distinct(F.transform("evidence", lambda e: e["source_id"]))).alias("source_count"), F.coalesce("size", F.lit(1)).alias("cluster_size"),
    )
    scored = cut_lineage(dream.score(candidates, now))
    r = dream.report(scored).first()
    return {
        "light_candidates": r.candidates, "rem_clusters": clustered.select("leader").distinct().count(), "deep_promoted": r.promoted, "deep_discarded": r.discarded, "duration_seconds": round(time.time() - started, 2),
    }
