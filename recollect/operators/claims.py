"""Claims from markdown and prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T


def section_weight(section: Column) -> Column:
    """Evidence weight of a section; tertiary for unknown ones."""
    out = F.lit(L.TERTIARY)
    for name, (weight, _) in L.SECTIONS.items():
        out = F.when(section == name, weight).otherwise(out)
    return out


def section_tag(section: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (_, tag) in L.SECTIONS.items():
        out = F.when(section == name, tag).otherwise(out)
    return out


def lines(docs: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, pos, line, section, block): lines with the section they stand in.

    A line of two or more ``#`` opens a section; ``block`` counts the openings before it.
    """
    split = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(T.strip(F.col(text)), "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line")))
    head = F.col("line").startswith("##")
    in_doc = Window.partitionBy(key).orderBy("pos")
    name = F.lower(T.strip(F.regexp_replace("line", "^#+", "")))
    return split.select(
        key, "pos", "line", head.alias("head"),
        F.coalesce(F.last(F.when(head, name), ignorenulls=True).over(in_doc), F.lit("")).alias("section"),
        F.sum(head.cast("int")).over(in_doc).alias("block"),
    )


def extract(docs: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, ordinal, text, kind, section, weight, tag, durability, polarity, confidence).

    List items of more than ten characters are claims.  Other lines of more than twenty are
    joined per section and cut into sentences; a sentence of fifteen characters or more
    is a claim if it signals a decision, fact or risk, or stands in a section of weight.
    In a section, list claims come before prose.  Lines of documents are grouped by
    document, so a window holds one document's lines only.
    """
    ls = lines(docs, key, text).where("not head and line <> '' and not startswith(line, '#')")
    item = F.col("line").startswith("- ") & (F.length("line") > 10)
    listed = ls.where(item).select(
        key, "block", F.lit(0).alias("part"), F.col("pos").alias("n"), T.strip(F.substring("line", 3, 1 << 30)).alias("text"), F.lit("list").alias("kind"), "section",
        section_weight(F.col("section")).alias("weight"), section_tag(F.col("section")).alias("tag"),
    )
    prose = ls.where(~item & (F.length("line") > 20)).groupBy(key, "block", "section").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), " ")
    sentences = prose.select(key, "block", "section", F.posexplode(F.split(F.regexp_replace(body, r"(?U)([.!?。！？])\s+", "$1\x01"), "\x01")).alias("n", "s")).withColumn("s", T.strip(F.col("s"))).where("length(s) >= 15")
    s = F.col("s")
    tag = F.when(T.signal(s, L.DECISION), "decision").when(T.signal(s, L.FACT), "fact").when(T.signal(s, L.RISK), "risk")
    weight = F.when(T.signal(s, L.DECISION), L.PRIMARY).when(T.signal(s, L.FACT) | T.signal(s, L.RISK), L.SECONDARY)
    strong = section_weight(F.col("section")) >= L.SECONDARY
    told = sentences.select(
        key, "block", F.lit(1).alias("part"), "n", F.substring("s", 1, 500).alias("text"), F.lit("prose").alias("kind"), "section",
        F.coalesce(weight, F.when(strong, section_weight(F.col("section")))).alias("weight"), F.coalesce(tag, F.when(strong, section_tag(F.col("section")))).alias("tag"),
    ).where("weight is not null")
    both = listed.unionByName(told)
    in_doc = Window.partitionBy(key).orderBy("block", "part", "n")
    w = F.col("weight")
    return both.select(
        key, F.row_number().over(in_doc).alias("ordinal"), "text", "kind", "section", "weight", "tag",
        T.durability(F.col("text"), F.coalesce("tag", F.lit(""))).alias("durability"), T.polarity(F.col("text")).alias("polarity"),
        F.round(F.least(F.lit(0.95), w / (w + 1)), 3).alias("confidence"),
    )


def foresight(claims: DataFrame, as_of: float, text: str = "text") -> DataFrame:
    """Forward-looking texts with the time they fall due, in unix seconds."""
    days = T.foresight_days(F.col(text))
    return claims.withColumn("days", days).where("days is not null").withColumn("valid_until", F.lit(float(as_of)) + F.col("days") * 86400).withColumn(text, F.substring(text, 1, 500)).withColumn("status", F.lit("pending"))


def claim_id(*parts: Column) -> Column:
    """A deterministic id of eight characters."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 8)
