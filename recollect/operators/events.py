"""The event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("source_id", "session_id", "agent", "ts", "type", "role", "name", "content", "args_json", "result", "error", "path", "metadata_json")


def select_events(events: DataFrame, type: str | None = None, session_id: str | None = None, agent: str | None = None, source_id: str | None = None, since: float | None = None, until: float | None = None) -> DataFrame:
    """the conjunction of the given filters; times inclusive.  All reach the scan."""
    for column, value in (("type", type), ("session_id", session_id), ("agent", agent), ("source_id", source_id)):
        if value is not None:
            events = events.where(F.col(column) == value)
    if since is not None:
        events = events.where(F.col("ts") >= float(since))
    if until is not None:
        events = events.where(F.col("ts") <= float(until))
    return events


def query_events(events: DataFrame, limit: int = 100, descending: bool = False, **filters) -> DataFrame:
    """Filtered, ordered by (ts, id) and cut at ``limit``; JSON columns also as values."""
    ts = F.col("ts").desc() if descending else F.col("ts").asc()
    rows = select_events(events, **filters).orderBy(ts, F.col("id").desc() if descending else F.col("id")).limit(limit)
    return rows.withColumn("args", F.try_parse_json("args_json")).withColumn("metadata", F.try_parse_json("metadata_json"))


def append_rows(documents: DataFrame) -> DataFrame:
    """One row for each event of each document, in the table's columns.

    ``documents`` is (source_id, session_id, agent, events array<struct>).  Absent strings are empty.
    """
    e = documents.select("source_id", "session_id", "agent", F.explode("events").alias("e"))
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema["events"].dataType.elementType.fields}
    fields = set(kinds)
    text = lambda n: F.coalesce(F.col(f"e.{n}").cast("string"), F.lit("")) if n in fields else F.lit("")
    js = lambda n: text(n) if kinds.get(n) in (None, "string") else F.coalesce(F.to_json(f"e.{n}"), F.lit(""))
    return e.select(
        F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("session_id", F.lit("")).alias("session_id"), F.coalesce("agent", F.lit("")).alias("agent"),
        (F.col("e.ts").cast("double") if "ts" in fields else F.lit(0.0)).alias("ts"), *(text(n).alias(n) for n in ("type", "role", "name", "content")), js("args").alias("args_json"),
        *(text(n).alias(n) for n in ("result", "error", "path")), js("metadata").alias("metadata_json"),
    )


def without_source(events: DataFrame, source_ids: DataFrame) -> DataFrame:
    """The table without some sources' rows; a rewrite, since files are immutable."""
    return events.join(source_ids.select("source_id").distinct(), "source_id", "left_anti")


def stats(events: DataFrame) -> DataFrame:
    """E5: (dimension, value, n): rows in all, by type and by agent, and sessions."""
    one = F.lit("")
    by = lambda c: events.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(c).alias("dimension"), F.coalesce(F.col(c), one).alias("value"), "n")
    total = events.agg(F.count("*").alias("n")).select(F.lit("total").alias("dimension"), one.alias("value"), "n")
    sessions = events.where("session_id <> ''").select("session_id").distinct().agg(F.count("*").alias("n")).select(F.lit("sessions").alias("dimension"), one.alias("value"), "n")
    return total.unionByName(sessions).unionByName(by("type")).unionByName(by("agent")).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def distinct_events(events: DataFrame) -> DataFrame:
    """The table without rows that were stored again: the first id of each equal event stays."""
    keys = [c for c in COLUMNS if c in events.columns]
    return events.groupBy(F.sha2(F.to_json(F.struct(*keys)), 256).alias("k")).agg(F.min_by(F.struct(*events.columns), "id").alias("r")).select("r.*")
