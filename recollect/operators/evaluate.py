"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as T


def hit_ranks(ranked: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """B1: (query_id, hit): the first rank at which a gold document stands; null for a miss."""
    hits = ranked.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("hit"))
    return queries.select("query_id").distinct().join(hits, "query_id", "left")


def metrics(hits: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20), by: str | None = None) -> DataFrame:
    """B2: recall at k, mean reciprocal rank and NDCG at 10, rounded to four digits."""
    share = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 4)
    h = F.col("hit")
    out = [F.count("*").alias("queries"), *(share(F.coalesce(h <= k, F.lit(False))).alias(f"recall_{k}") for k in ks)]
    out.append(F.round(F.avg(F.coalesce(1.0 / h, F.lit(0.0))), 4).alias("mrr"))
    out.append(F.round(F.avg(F.when(h <= 10, 1.0 / F.log2(h + 1.0)).otherwise(0.0)), 4).alias("ndcg_10"))
    return hits.groupBy(by).agg(*out) if by else hits.agg(*out)


def keyword_hit(keywords: Column, *texts: Column) -> Column:
    """Any keyword in the texts, blanks between scripts removed."""
    body = F.lower(T.space_scripts(F.concat_ws(" ", *texts)))
    return F.exists(keywords, lambda k: body.contains(F.lower(T.space_scripts(k))))


def failure_kind(hit: Column, overlap: Column) -> Column:
    """What kind of failure a query is, by its hit rank and shared long words."""
    return F.when(hit <= 5, "hit").when(hit.isNotNull(), "ranked_low").when(overlap == 0, "no_overlap").when(overlap < 3, "weak_overlap").otherwise("missed")


def long_word_overlap(a: Column, b: Column) -> Column:
    """Distinct words of more than three characters that two texts share."""
    words = lambda c: F.array_distinct(F.filter(T.all_matches(F.lower(c), r"\w+"), lambda w: F.length(w) > 3))
    return F.size(F.array_intersect(words(a), words(b)))


#: Type of a question that has no answer (fixed value).
ABSTENTION = "abstention"


def answerable(questions: DataFrame, first: int | None = None) -> DataFrame:
    """(question_id, question_type, ...) of questions that have an answer; the first of them in the ids' order if asked.

    A question without a type has an answer.
    """
    kept = questions.where(F.coalesce("question_type", F.lit("")) != ABSTENTION)
    return kept if first is None else kept.orderBy("question_id").limit(first)


def haystacks(spark: SparkSession, questions: int, sessions: int = 48, seed: int = 42) -> DataFrame:
    """Synthetic questions with one answer among many sessions, by hash and not by state."""
    topics = ["piano", "garden", "bicycle", "pottery", "chess", "sourdough", "kayak", "telescope"]
    pick = lambda *cs: F.element_at(F.array(*(F.lit(t) for t in topics)), (F.pmod(F.xxhash64(F.lit(seed), *cs), F.lit(len(topics))) + 1).cast("int"))
    base = spark.range(questions).withColumnRenamed("id", "question_id").withColumn("gold", F.pmod(F.xxhash64(F.lit(seed), "question_id"), F.lit(sessions)))
    rows = base.withColumn("session", F.explode(F.sequence(F.lit(0), F.lit(sessions - 1))))
    said = F.when(F.col("session") == F.col("gold"), F.concat(F.lit("By the way, I started "), pick("question_id"), F.lit(" lessons number "), F.col("question_id").cast("string"), F.lit(" last week."))).otherwise(
        F.concat(F.lit("We talked about "), pick("question_id", "session"), F.lit(" and the weather."))
    )
    return rows.select("question_id", F.concat("question_id", F.lit("_"), "session").alias("session_id"), (F.col("session") == F.col("gold")).alias("is_answer"), said.alias("content"), F.concat(F.lit("When did I start "), pick("question_id"), F.lit(" lessons number "), F.col("question_id").cast("string"), F.lit("?")).alias("question"))
