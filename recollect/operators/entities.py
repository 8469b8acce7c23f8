"""Entities from text, their resolution and their links to claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T


def _explode_patterns(docs: DataFrame, key: str, text: str, patterns: list[tuple[int, str, str]]) -> DataFrame:
    """(key, rank, type, name) of every match; (rank, type, pattern) with group 1 as the name."""
    found = F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(t).alias("type"), T.all_matches(F.col(text), p, 1).alias("names")) for r, t, p in patterns))
    return docs.select(key, F.explode(found).alias("f")).select(key, "f.rank", "f.type", F.posexplode("f.names").alias("pos", "name")).withColumn("name", T.strip(F.col("name")))


def typed(docs: DataFrame, key: str = "id", text: str = "content", extra: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, name, type); the first type wins, and a name within a longer one of the
    same type is dropped.  ``extra`` adds types with patterns of its own."""
    patterns = [(i * 100 + j, t, p if p.startswith("(?i)") else "(?U)" + p) for i, (t, ps) in enumerate(L.TYPED) for j, p in enumerate(ps)]
    first = len(L.TYPED) * 100
    hits = _explode_patterns(docs, key, text, patterns).where("length(name) >= 2")
    one = hits.groupBy(key, "name").agg(F.min(F.struct("rank", "type"))["type"].alias("type"))
    # names of one document and type, compared among themselves as arrays: a document's length
    longer = one.groupBy(key, "type").agg(F.collect_set("name").alias("names"))
    inside = F.exists("names", lambda o: (F.length(o) > F.length(F.col("name"))) & o.contains(F.col("name")))
    kept = longer.select(key, "type", "names", F.explode("names").alias("name")).where(~inside).select(key, "name", "type")
    if extra:
        own = [(first + i, t, "(?iU)" + (p if "(" in p else f"({p})")) for i, (t, ps) in enumerate(extra.items()) for p in ps]
        more = _explode_patterns(docs, key, text, own).where("length(name) >= 2").groupBy(key, "name").agg(F.min(F.struct("rank", "type"))["type"].alias("type"))
        kept = kept.unionByName(more.join(kept.select(key, "name"), [key, "name"], "left_anti"))
    return kept


def is_non_entity(name: Column, stop_cn: frozenset[str] | None = None) -> Column:
    """too short, a number, a stop word, or CJK that starts or consists of fragments."""
    words = stop_cn or L.name_stop_cn()
    listed = F.array(*(F.lit(w) for w in sorted(words)))
    stop_en = F.array(*(F.lit(w) for w in L.NAME_STOP_EN))
    many = "|".join(sorted((w for w in words if len(w) > 1), key=len, reverse=True))
    every = "|".join(sorted(words, key=len, reverse=True))
    title = name.rlike("^[A-Z][a-z]*$")
    cjk = name.rlike(f"^[{T.CJK}]+$")
    return (
        name.isNull() | (F.length(name) < 2) | F.regexp_replace(name, "[,. ]", "").rlike(r"^\d+$") | F.array_contains(listed, name)
        | (title & F.array_contains(stop_en, F.lower(name))) | (cjk & name.rlike(f"^[{L.FRAGMENT_STARTERS}]")) | (cjk & name.rlike(f"^(?:{many})*(?:{every})$"))
    )


def cjk_chunks(text: Column, stop_cn: frozenset[str] | None = None) -> Column:
    """Names between stop words and particles; long ones only with a type suffix, else
    their first and last four characters."""
    words = sorted((w for w in (stop_cn or L.name_stop_cn()) if len(w) > 1), key=len, reverse=True)
    cut = F.regexp_replace(text, f"(?:{'|'.join(words)}|[{L.PARTICLES}])", "\x01")
    chunks = T.all_matches(cut, f"[{T.CJK}]{{2,}}")

    def kept(c: Column) -> Column:
        short = F.length(c) <= 4
        return F.when(short | (T.suffix_type(c) != "named"), F.array(c)).otherwise(F.array(F.substring(c, 1, 4), F.substring(c, F.length(c) - 3, F.lit(4))))

    return F.array_distinct(F.flatten(F.transform(chunks, kept)))


def candidates(docs: DataFrame, key: str = "id", text: str = "content", stop_cn: frozenset[str] | None = None) -> DataFrame:
    """(key, name) of noun-like strings."""
    patterns = [(i, "", p if "\\b" not in p else "(?U)" + p) for i, p in enumerate(L.CANDIDATES)]
    latin = _explode_patterns(docs, key, text, patterns).select(key, F.regexp_replace("name", "^(?:The|A|An) ", "").alias("name"))
    cjk = docs.select(key, F.explode(cjk_chunks(F.col(text), stop_cn)).alias("name"))
    return latin.unionByName(cjk).where(~is_non_entity(F.col("name"), stop_cn)).distinct()


def extract(docs: DataFrame, key: str = "id", text: str = "content", extra_patterns: dict[str, list[str]] | None = None, extra_names: list[str] | None = None, stop_cn: frozenset[str] | None = None) -> DataFrame:
    """(key, name, type): typed names first, then glossary names, then candidates."""
    out = typed(docs, key, text, extra_patterns).withColumn("p", F.lit(0))
    if extra_names:
        held = F.filter(F.array(*(F.lit(n) for n in extra_names)), lambda n: F.col(text).contains(n))
        out = out.unionByName(docs.select(key, F.explode(held).alias("name")).select(key, "name", T.suffix_type(F.col("name")).alias("type"), F.lit(1).alias("p")))
    found = candidates(docs, key, text, stop_cn).select(key, "name", T.suffix_type(F.col("name")).alias("type"), F.lit(2).alias("p"))
    return out.unionByName(found).groupBy(key, "name").agg(F.min(F.struct("p", "type"))["type"].alias("type"))


def resolve(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity_id, is_new): entities by name or alias, whatever the case, else new ones.

    ``entities`` is (id, name, aliases).  If several match, the smallest id counts.
    """
    names = entities.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    known = names.select(F.lower(F.trim("n")).alias("low"), "id").where("low <> ''").groupBy("low").agg(F.min("id").alias("id"))
    distinct = found.select("name", F.lower(F.trim("name")).alias("low")).distinct()
    return distinct.join(known, "low", "left").select("name", F.coalesce("id", F.substring(F.sha2("low", 256), 1, 8)).alias("entity_id"), F.col("id").isNull().alias("is_new"))


def link(claims: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """(claim_id, entity_id): the name that stands first in the claim's text.

    ``claims`` is (by..., claim_id, text), ``names`` (by..., entity_id, name); only names of the
    same ``by`` are tried.  Ties: the longer name, then by name.
    """
    pos = F.instr(F.lower("text"), F.lower("name"))
    met = claims.join(names, by).withColumn("pos", pos).where("pos > 0")
    best = F.min(F.struct("pos", (-F.length("name")).alias("l"), "name", "entity_id"))
    return met.groupBy("claim_id").agg(best["entity_id"].alias("entity_id"))
