"""The search engine over a batch of queries, one lazy plan from rewriting to reranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import graph, rerank, retrieval
from recollect.session import cut_lineage


@dataclass(frozen=True)
class Index:
    """What queries are answered from.

    ``docs`` is ``retrieval.index_documents``, ``search`` its stored index (``retrieval.build_index``),
    without which texts are tokenised for each batch of queries; ``names`` (entity_id, name) and ``edges`` (entity_id,
    source_id) serve the graph, ``vectors`` (doc_id, vector) vector search.  Each may be absent.
    """

    docs: DataFrame
    names: DataFrame | None = None
    edges: DataFrame | None = None
    vectors: DataFrame | None = None
    search: retrieval.SearchIndex | None = None


def rewrite(queries: DataFrame) -> DataFrame:
    """(query_id, original, keyword, entity, semantic)."""
    q = T.strip(F.col("query"))
    return queries.select("query_id", q.alias("original"), T.keyword_query(q).alias("keyword"), T.entity_query(q).alias("entity"), q.alias("semantic"))


def _variants(r: DataFrame, *variants: tuple[str, str | None]) -> DataFrame:
    """Several forms of the queries as one query set: query_id is (variant, query_id)."""
    out = None
    for n, (column, condition) in enumerate(variants):
        part = (r.where(condition) if condition else r).select(F.struct(F.lit(n).alias("variant"), "query_id").alias("query_id"), F.col(column).alias("query"))
        out = part if out is None else out.unionByName(part)
    return out


def _of(ranked: DataFrame, variant: int, k: int) -> DataFrame:
    return ranked.where((F.col("query_id.variant") == variant) & (F.col("rank") <= k)).select(F.col("query_id.query_id").alias("query_id"), "doc_id", "score", "rank")


def candidate_lists(index: Index, queries: DataFrame, k: int, query_vectors: DataFrame | None = None) -> list[tuple[DataFrame, float]]:
    """The weighted ranked lists that are fused; variants only where they differ.

    Both forms of the queries for exact search, and both for BM25, are one query set each, so
    the texts are read once for each of the two.
    """
    r = cut_lineage(rewrite(queries))
    raw = index.docs.select("doc_id", F.col("raw").alias("text"))
    exact = cut_lineage(retrieval.exact(raw, _variants(r, ("original", None), ("entity", "entity <> '' and entity <> original")), 3 * k).select("query_id", "doc_id", "score", "rank"))
    bm25 = cut_lineage(retrieval.bm25(index.search or index.docs, _variants(r, ("original", None), ("keyword", "keyword <> '' and keyword <> original")), 3 * k))
    lists = [(_of(exact, 0, 3 * k), 2.0), (_of(exact, 1, 2 * k), 1.0), (_of(bm25, 0, 3 * k), 2.0), (_of(bm25, 1, 2 * k), 1.5)]
    if index.vectors is not None and query_vectors is not None:
        lists.append((retrieval.vector_search(index.vectors, query_vectors, 3 * k), 2.0))
    if index.names is not None and index.edges is not None:
        lists.append((graph.graph_search(index.names, index.edges, r.select("query_id", F.col("original").alias("query")), 2 * k), 0.5))
    return lists


def pool(index: Index, queries: DataFrame, k: int = 5, query_vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the fused first of each query, fact children as their parents."""
    return cut_lineage(retrieval.by_parent(retrieval.rrf(candidate_lists(index, queries, k, query_vectors), max(6 * k, 30))))


def search(index: Index, queries: DataFrame, k: int = 5, query_vectors: DataFrame | None = None, reranked: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, score): the best k documents of each query."""
    fused = pool(index, queries, k, query_vectors)
    if not reranked:
        return fused.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
    return rerank.rerank(fused, index.docs, queries, k, index.search.frequencies if index.search else None).select("query_id", "rank", "doc_id", "score")


def show(results: DataFrame, index: Index, queries: DataFrame) -> DataFrame:
    """Results with title, type and snippet."""
    x = results.join(index.docs.select("doc_id", "title", "raw", "page_type"), "doc_id").join(queries, "query_id")
    return x.select("query_id", "rank", "doc_id", "page_type", "title", T.bm25_snippet(F.col("raw"), T.bm25_tokens(F.col("query"))).alias("snippet"), "score")
