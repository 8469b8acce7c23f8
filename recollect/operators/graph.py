"""The entity graph; entities are linked to sources, and through them to each other.

``edges`` is (entity_id, source_id), one row per mention; ``names`` (entity_id, name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.retrieval import top_k


def weighted_edges(edges: DataFrame) -> DataFrame:
    """(entity_id, source_id, ew): mentions of an edge over those of the strongest edge."""
    counts = edges.where("entity_id is not null and source_id is not null").groupBy("entity_id", "source_id").agg(F.count("*").alias("c"))
    top = counts.agg(F.max("c").alias("m"))  # one row
    return counts.crossJoin(F.broadcast(top)).select("entity_id", "source_id", (F.col("c") / F.col("m")).alias("ew"))


def roots(names: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, entity_id): entities whose name stands in the query, once per such name.

    Names are met by their words: a name in the query begins with the text's words, so the
    join key is a run of the query's characters of the name's length at each place.
    """
    lengths = names.select(F.length(F.trim("name")).alias("n")).where("n > 0").distinct()
    low = queries.select("query_id", F.lower("query").alias("q"))
    # lengths of names are few; each query is cut into pieces of those lengths
    cut = low.join(F.broadcast(lengths.agg(F.collect_set("n").alias("ns"))))
    pieces = cut.select("query_id", "q", F.explode("ns").alias("n")).where("length(q) >= n").select(
        "query_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("q") - F.col("n") + 1), lambda i: F.substring(F.col("q"), i, F.col("n"))))).alias("name")
    )
    known = names.select("entity_id", F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    return pieces.join(known, "name").select("query_id", "entity_id")


def neighbours(root: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(query_id, doc_id, score): sources one hop from the roots, and two hops if asked.

    A first-hop source has the sum of its edges to the roots.  A second-hop source is reached
    by way of another entity of a first-hop source, counts half of its edge for every
    path, and only if it isn't in the first hop.
    """
    e = weighted_edges(edges)
    r = root.groupBy("query_id", "entity_id").agg(F.count("*").alias("times"))
    hop1 = r.join(e, "entity_id").groupBy("query_id", "source_id").agg(F.sum(F.col("ew") * F.col("times")).alias("score"))
    out = hop1.select("query_id", F.col("source_id").alias("doc_id"), "score")
    if hops > 1:
        # paths are counted, not listed: how many ways lead to an entity, times its edges
        ways = hop1.select("query_id", "source_id").join(e.select("source_id", "entity_id"), "source_id").groupBy("query_id", "entity_id").agg(F.count("*").alias("ways"))
        ways = ways.join(r.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti")
        hop2 = ways.join(e, "entity_id").groupBy("query_id", "source_id").agg(F.sum(F.col("ew") * 0.5 * F.col("ways")).alias("score"))
        hop2 = hop2.join(hop1.select("query_id", "source_id"), ["query_id", "source_id"], "left_anti")
        out = out.unionByName(hop2.select("query_id", F.col("source_id").alias("doc_id"), "score"))
    return out


def graph_search(names: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, hops: int = 2) -> DataFrame:
    """The k best sources of each query by way of the entities it names."""
    scored = neighbours(roots(names, queries), edges, hops).select("query_id", "doc_id", F.round("score", 4).alias("score"))
    return top_k(scored, k)
