"""One ranking per query from scores on different scales.

Method: in each list of a query a score is standardised with the median and the median
absolute deviation, so that neither range nor outliers matter; a logistic function bounds
it between ``LOW`` and 1, which takes what remains of the outliers on both sides; and the
weighted geometric mean of the bounded values orders the pages, so a page must do well in
every list to come first, but no list alone can raise or sink it.

Medians come from mergeable summaries of bounded size (exact up to ``ACCURACY`` scores in
a list, within 1/ACCURACY of the rank beyond), so a query that holds a third of all rows
needs no more memory than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: Makes the median absolute deviation estimate a standard deviation (fixed value).
MAD_SCALE = 1.4826
#: The least bounded value: in a geometric mean one near zero would outweigh all other lists.
LOW = 0.25
#: Bounded values are compared after rounding, so that sums in another order tie alike.
DIGITS = 9
#: Slices of the value range in which ranks are counted separately.
SLICES = 64


def all_scores(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, list_name, id, score): the lists' scores and, as list 'dream', the best
    candidate score of each page found.  Null and NaN scores are left out: missing."""
    listed = (
        results.where("query_id is not null and id is not null and list_name is not null")
        .select("query_id", "list_name", "id", F.when(~F.isnan("score"), F.col("score")).alias("score"))
        .groupBy("query_id", "list_name", "id").agg(F.max("score").alias("score"))
    )
    pages = listed.select("query_id", "id").distinct()
    best = candidates.where("source_id is not null and score is not null and not isnan(score)").groupBy(F.col("source_id").alias("id")).agg(F.max("score").alias("score"))
    dream = pages.join(best, "id").select("query_id", F.lit("dream").alias("list_name"), "id", "score")
    return listed.unionByName(dream)


def fuse(scores: DataFrame, weights: dict[str, float] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(query_id, id, value): value between 0 and 1, the weighted geometric mean.

    ``weights`` by list name, 1 by default; a weight of 0 leaves a list out.  A missing
    score counts less than any present one of its list: its bounded value is half of the
    least.  Lists that have no score for a query don't count for it.  If all scores of a
    list are equal, each is at the centre.  Infinite scores count as very large or small.
    A page without any score still gets a value, below all others'.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("list_name") == name, F.lit(float(w))).otherwise(weight)
    # greatest and least skip nulls, and a missing score must stay one
    within = F.least(F.greatest(F.col("score"), F.lit(-1e150)), F.lit(1e150))
    clipped = scores.withColumn("score", F.when(F.col("score").isNotNull() & ~F.isnan("score"), within)).withColumn("w", weight).where("w > 0")
    by = ["query_id", "list_name"]
    present = clipped.where("score is not null")
    centre = present.groupBy(by).agg(F.percentile_approx("score", 0.5, accuracy).alias("median"), F.max("w").alias("list_w"))
    off = present.join(centre, by).withColumn("off", F.abs(F.col("score") - F.col("median")))
    spread = off.groupBy(*by, "median", "list_w").agg(
        F.percentile_approx("off", 0.5, accuracy).alias("mad"), F.avg("off").alias("mean_off"), F.min("score").alias("least")
    )
    scale = F.when(F.col("mad") > 0, F.col("mad") * MAD_SCALE).when(F.col("mean_off") > 0, F.col("mean_off")).otherwise(F.lit(1.0))
    def bounded(c):
        z = F.least(F.greatest((c - F.col("median")) / F.col("scale"), F.lit(-60.0)), F.lit(60.0))
        return F.log(F.lit(LOW) + F.lit(1 - LOW) / (1 + F.exp(-z)))

    stats = spread.withColumn("scale", scale)
    stats = stats.select(*by, "median", "scale", "list_w", (bounded(F.col("least")) - F.log(F.lit(2.0))).alias("floor"))
    per_query = stats.groupBy("query_id").agg(F.sum(F.col("list_w") * F.col("floor")).alias("floors"), F.sum("list_w").alias("total_w"))
    gain = F.when(F.col("score").isNotNull() & F.col("median").isNotNull(), F.col("w") * (bounded(F.col("score")) - F.col("floor"))).otherwise(F.lit(0.0))
    pages = clipped.join(stats, by, "left").withColumn("gain", gain).groupBy("query_id", "id").agg(F.sum("gain").alias("gain"))
    return (
        pages.join(per_query, "query_id", "left")
        .select("query_id", "id", F.round(F.coalesce(F.exp((F.col("floors") + F.col("gain")) / F.col("total_w")), F.lit(0.0)), DIGITS).alias("value"))
    )


def best_pages(fused: DataFrame) -> DataFrame:
    """(query_id, id, value): the first page of each query; ties by id.

    An aggregate with partial results, so no query is ever sorted as a whole.
    """
    top = fused.groupBy("query_id").agg(F.min(F.struct((-F.col("value")).alias("v"), "id")).alias("t"))
    return top.select("query_id", "t.id", (-F.col("t.v")).alias("value"))


def ranks(fused: DataFrame, slices: int = SLICES) -> DataFrame:
    """(query_id, rank, id, value): all pages of each query in order, from 1; ties by id.

    Ranks are counted in slices of the value range and offset by the sizes of the slices
    above, so that a query with very many pages is ordered by many tasks.
    """
    cut = fused.withColumn("slice", F.least(F.floor((1 - F.col("value")) * slices), F.lit(slices - 1)))
    sizes = cut.groupBy("query_id", "slice").agg(F.count("*").alias("n"))
    above = sizes.select(
        "query_id", "slice", (F.sum("n").over(Window.partitionBy("query_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("above")
    )
    within = F.row_number().over(Window.partitionBy("query_id", "slice").orderBy(F.col("value").desc(), "id"))
    return cut.withColumn("within", within).join(above, ["query_id", "slice"]).select("query_id", (F.col("above") + F.col("within")).cast("int").alias("rank"), "id", "value")
