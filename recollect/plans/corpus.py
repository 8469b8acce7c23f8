"""The operators' inputs out of the driver's tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import retrieval, truth
from recollect.plans.engine import Index
from recollect.session import cut_lineage, spread, spread_rows
from recollect.sources.tables import table

#: The time that operators take as now: the end of the tables' year.
AS_OF = 1767225600.0
#: So many characters of a source are kept on disk; claims, entities and search read all.
STORED_CHARS = 10_000


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a text as (doc_id, title, text, raw, page_type)."""
    x = spread(table(spark, d, "documents")).where("text is not null")
    return x.select("doc_id", T.title_of(F.col("text")).alias("title"), "text", F.col("text").alias("raw"), F.lit("source").alias("page_type"))


def whole_texts(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query): every document's whole text, for the row-wise text functions."""
    return spread(table(spark, d, "documents")).where("text is not null").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


#: Stored indexes of this process, by session, tables and their files.
_STORED: dict[tuple, object] = {}


def stored(spark: SparkSession, d: str, names: tuple[str, ...], what: str, make: Callable):
    """What ``make`` builds from the tables, built once for each session and state of their files."""
    files = tuple(sorted(f for n in names for f in spark.read.parquet(f"{d}/{n}.parquet").inputFiles()))
    stamp = tuple((f, os.stat(p).st_mtime_ns) if os.path.exists(p := f.removeprefix("file://")) else (f, 0) for f in files)
    key = (spark.sparkContext.applicationId, what, stamp)
    if key not in _STORED:
        _STORED[key] = make()
    return _STORED[key]


def documents_index(spark: SparkSession, d: str) -> retrieval.SearchIndex:
    """The stored index of the documents."""
    return stored(spark, d, ("documents",), "documents", lambda: retrieval.build_index(documents(spark, d), frequencies=False))


def is_query(number: Column) -> Column:
    """The stated query set: rows whose id is divisible by 50."""
    return number % 50 == 0


def document_queries(spark: SparkSession, d: str, words: int = 12) -> DataFrame:
    """(query_id, query): the first words of every document whose id is divisible by 50."""
    x = table(spark, d, "documents").where("text is not null").where(is_query(F.col("doc_id")))
    return x.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(T.all_matches(F.col("text"), r"\S+"), 1, words), " ").alias("query")).where("query <> ''")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources once each, with their whole content."""
    x = table(spark, d, "vault_sources").where("id is not null")
    one = x.groupBy("id").agg(F.min(F.struct("ingested_at", "title", "content", "source_type", "path")).alias("r"))
    return one.select("id", "r.title", "r.content", "r.source_type", "r.path", "r.ingested_at")


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims once each, as ``truth`` reads them."""
    x = table(spark, d, "vault_claims").where("id is not null")
    keep = ["entity_id", "text", "tags", "status", "polarity", "durability", "confidence", "created_at", "evidence"]
    return x.groupBy(F.col("id").alias("claim_id")).agg(F.min(F.struct(*keep)).alias("r")).select("claim_id", "r.*")


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vault_entities").where("id is not null and name is not null").withColumn("name", F.trim("name"))


def vault_index(spark: SparkSession, d: str, facts: bool = False) -> Index:
    """Sources and entity pages with their graph and stored index."""
    return stored(spark, d, ("vault_sources", "vault_claims", "vault_entities"), f"vault {facts}", lambda: _vault_index(spark, d, facts))


def _vault_index(spark: SparkSession, d: str, facts: bool) -> Index:
    c = claims(spark, d)
    texts = truth.active(c).where("entity_id is not null and text is not null").groupBy("entity_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("created_at", "claim_id", "text"))), lambda x: x["text"]).alias("claims"))
    e = entities(spark, d)
    pages = e.select("id", "name").join(truth.summaries(c).withColumnRenamed("entity_id", "id"), "id", "left").join(texts.withColumnRenamed("entity_id", "id"), "id", "left")
    names = e.select(F.col("id").alias("entity_id"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    edges = e.select(F.col("id").alias("entity_id"), F.explode("backlinks").alias("source_id"))
    docs = cut_lineage(spread_rows(retrieval.index_documents(sources(spark, d), pages, facts)))
    return Index(docs, names, edges, search=retrieval.build_index(docs))
