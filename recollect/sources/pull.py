"""Incremental pulls by fingerprint.

``items`` is (adapter, id, fingerprint, ...) as discovered, ``state`` (adapter, id, fingerprint) as
kept from earlier pulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(items: DataFrame, state: DataFrame) -> DataFrame:
    """Items with ``state``: 'new', 'changed' or 'unchanged'; one join on (adapter, id)."""
    known = state.select("adapter", "id", F.col("fingerprint").alias("__known")).dropDuplicates(["adapter", "id"])
    verdict = F.when(F.col("__known").isNull(), "new").when(F.col("__known") == F.col("fingerprint"), "unchanged").otherwise("changed")
    return items.join(known, ["adapter", "id"], "left").withColumn("state", verdict).drop("__known")


def due(items: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """The items to fetch: all if forced, else the new and changed ones."""
    return items if force else items.join(state.select("adapter", "id", "fingerprint"), ["adapter", "id", "fingerprint"], "left_anti")


def next_state(state: DataFrame, ingested: DataFrame) -> DataFrame:
    """State after a pull: what was ingested, and what it left untouched.

    Items whose fetch gave nothing or failed are not in ``ingested`` and keep their old entry.
    """
    new = ingested.select("adapter", "id", "fingerprint").dropDuplicates(["adapter", "id"])
    return state.select("adapter", "id", "fingerprint").join(new.select("adapter", "id"), ["adapter", "id"], "left_anti").unionByName(new)


def report(items: DataFrame, state: DataFrame, ingested: DataFrame, failed: DataFrame) -> DataFrame:
    """One row of counters: discovered, ingested, errors and skipped."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = n(items, "discovered").crossJoin(n(ingested, "ingested")).crossJoin(n(failed, "errors"))
    return one.withColumn("skipped", F.col("discovered") - F.col("ingested") - F.col("errors"))
