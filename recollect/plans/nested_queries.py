"""Queries over nested payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.operators import nested
from recollect.sources.tables import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(umsf_id, node, parent) of every object that is a list element."""
    return nested.links(nested.label(table(spark, d, "umsf_raw")))


def p7_tables(spark: SparkSession, d: str) -> DataFrame:
    """All flat tables in one relation."""
    return nested.flat(nested.label(table(spark, d, "umsf_raw")))


def p7_events(spark: SparkSession, d: str) -> DataFrame:
    """The table of events, typed columns."""
    columns = {c: c for c in ("type", "ts", "role", "name", "content", "path", "error")}
    return nested.table_at(p7_tables(spark, d), "$.events[]", columns)


QUERIES = {f.__name__: f for f in (p7_found, p7_tables, p7_events)}
