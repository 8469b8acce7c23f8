"""Mixing sources to target shares of all tokens.

Method: every document draws a hash-random key for each pass over its source; the keys
order the source's documents, token counts are prefix-summed in that order, and the
source is cut exactly at its budget.  A source whose budget exceeds its size is taken
whole several times, each pass in another order, up to its allowed repeats.

The order is never built by one task: keys are uniform by construction, so equal key
ranges are equal shares of a source whatever its size.  Sums per range are small, their
prefix sums give each range's offset, and running sums are only taken inside a range.
A source with a third of all rows is thus split like any other, without sampling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import bpe
from recollect.session import cut_lineage

#: Equal key ranges per source and pass.
RANGES = 1024


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    seed: int = 7,
    ranges: int = RANGES,
    folder: str = bpe.TOKENIZERS,
) -> DataFrame:
    """(source, doc_id, pass, n_tokens, taken): the documents of the mixture.

    ``total_tokens`` is the wanted size; by default the size of the documents whose
    source has a target.  A source's budget is its share of it, at most ``max_repeats``
    times its own size.  ``taken`` is ``n_tokens`` but for the one document on which
    the budget ends, of which only the first ``taken`` tokens belong to the mixture, so
    that each source's sum is its budget exactly.  Documents without a source or of a
    source without a target, and documents of no tokens, are not taken; a source
    without documents gives nothing.  A null or negative share or repeat counts as 0; if
    a source is listed twice, its greatest share and repeat count.  Repeated documents
    are different rows if their ids differ; a row delivered twice counts once.
    """
    goal = targets.where("source is not null").groupBy("source").agg(
        F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("share"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).cast("bigint").alias("repeats"),
    )
    wanted = documents.where("source is not null and text is not null").join(goal.select("source"), "source", "left_semi")
    sized = bpe.count_tokens(wanted, ["source", "doc_id"], folder=folder).where("n_tokens > 0")
    # read twice below, and counting tokens is the costly part
    sized = cut_lineage(sized.groupBy("source", "doc_id").agg(F.max("n_tokens").alias("n_tokens")))
    has = sized.groupBy("source").agg(F.sum("n_tokens").alias("size"))
    if total_tokens is None:
        # one row for each source with a target: a window without partition over a handful of rows
        has = has.withColumn("total", F.sum("size").over(Window.partitionBy()))
    else:
        has = has.withColumn("total", F.lit(int(total_tokens)).cast("bigint"))
    budget = has.join(goal, "source").withColumn(
        "budget", F.least(F.round(F.col("share") * F.col("total")).cast("bigint"), F.col("repeats") * F.col("size"))
    )
    # passes over the source: whole ones, and a last one that may be cut
    passes = budget.where("budget > 0").withColumn("passes", F.ceil(F.col("budget") / F.col("size"))).select("source", "size", "budget", "passes")
    drawn = (
        sized.join(passes, "source")
        .withColumn("pass", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("passes"))))
        .withColumn("left", F.least(F.col("budget") - (F.col("pass") - 1) * F.col("size"), F.col("size")))
        .withColumn("key", F.xxhash64(F.lit(seed), F.col("pass"), F.col("doc_id")))
        .withColumn("range", F.pmod(F.shiftrightunsigned("key", 20), F.lit(ranges)))
    )
    sums = drawn.groupBy("source", "pass", "range").agg(F.sum("n_tokens").alias("in_range"))
    sums = sums.withColumn(
        "offset", F.sum("in_range").over(Window.partitionBy("source", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_range")
    ).select("source", "pass", "range", "offset")
    inside = Window.partitionBy("source", "pass", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = drawn.join(sums, ["source", "pass", "range"]).withColumn("start", F.col("offset") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return placed.where("start < left").select(
        "source", "doc_id", F.col("pass").cast("int").alias("pass"), "n_tokens", F.least(F.col("n_tokens"), F.col("left") - F.col("start")).alias("taken")
    )


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: what was asked for and what the mixture holds.

    (source, target_share, actual_share, tokens, documents, most_repeats); sources that
    gave nothing have zeros.
    """
    # documents of a hot source are pre-aggregated per document before the source is grouped
    docs = mixture.groupBy("source", "doc_id").agg(F.sum("taken").alias("tokens"), F.count("*").alias("times"))
    got = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.max("times").alias("most_repeats"))
    everything = Window.partitionBy()  # a row per target
    return (
        targets.where("source is not null")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"))
        .join(got, "source", "left")
        .select(
            "source",
            "target_share",
            F.round(F.coalesce(F.col("tokens"), F.lit(0)) / F.sum("tokens").over(everything), 6).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )
