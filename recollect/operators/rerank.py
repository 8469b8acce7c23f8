"""Reranking of a bounded pool per query with eight signals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from recollect.functions import text as T
from recollect.operators.retrieval import term_frequencies, top_k
from recollect.session import cut_lineage, spread_rows

#: Weights of the signals (fixed values); the last is added on top.
WEIGHTS = {"tfidf": 0.25, "coverage": 0.10, "phrase": 0.10, "title": 0.15, "position": 0.15, "together": 0.10, "original": 0.05}
DENSITY_BONUS = 0.08


def idf(docs: DataFrame, terms: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """(term, idf) of the given terms over all documents; unseen terms have the highest.

    ``frequencies`` is a stored (term, df).  Without it the documents' tokens are counted, of
    which only the queries' terms leave the scan, so the table is as long as the queries.
    """
    df = term_frequencies(docs, terms) if frequencies is None else frequencies
    n = docs.agg(F.count("*").alias("n"))
    return terms.select("term").distinct().join(df, "term", "left").crossJoin(F.broadcast(n)).select("term", (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1.0).alias("idf"))


#: R11g: characters that halve a window's density, and beyond which windows are not widened (fixed values).
NEAR, FAR = 200.0, 500
#: Starts of windows looked at in one piece.
STARTS = 8192


#: Characters of a long text that are looked at first: windows there may already give the most there is.
FIRST = 20_000


def density(terms: list[str], low: str, at: dict[str, np.ndarray] | None = None) -> float:
    """R11g of one text in lower case: the share of terms found and the densest window, half each.

    A window starts at an occurrence and ends at another; its density is the number of different
    terms over one plus its width in units of ``NEAR``.  The last window tried from a start is
    the first wider than ``FAR``.  With each term's next occurrence after every start in a row
    of a matrix, sorted, the m-th entry is the narrowest window of m terms.  ``at`` keeps the places
    of terms from one query of a text to the next.
    """
    at = {} if at is None else at
    share = sum(t in low for t in terms) / len(terms)
    for text in (low[:FIRST], low) if len(low) > FIRST else (low,):
        found = []
        for t in terms:
            if (key := (t, len(text))) not in at:
                at[key] = np.array([m.start() for m in re.finditer(f"(?={re.escape(t)})", text)])
            found.append(at[key])
        best = _densest([p for p in found if p.size], 2 - share)
        if share + best >= 2:
            return 1.0
    return min(1.0, share / 2 + best / 2)


def _densest(found: list[np.ndarray], enough: float) -> float:
    """The density of the densest window, or of one that is ``enough``."""
    starts = np.sort(np.concatenate(found)) if found else np.empty(0)
    if starts.size < 2:
        return 0.0
    best = 1 / (1 + (np.diff(starts).min() + 1) / NEAR)  # the next occurrence, of whichever term
    number = np.arange(1, len(found) + 1)
    for first in range(0, starts.size, STARTS):
        if best >= enough:
            break
        s = starts[first : first + STARTS]
        following = np.sort(np.stack([np.append(p, np.inf)[np.searchsorted(p, s)] for p in found], axis=1), axis=1)
        last = np.append(starts, np.inf)[np.searchsorted(starts, s + FAR)][:, None]
        within = (following < last) | ((following == last) & np.isfinite(following))
        score = np.where(within & (number > 1), number / (1 + (following - s[:, None] + 1) / NEAR), 0.0)
        best = max(best, float(score.max()))
    return best


@F.pandas_udf(DoubleType())
def cooccurrence(terms, texts):
    """R11g: how close the terms stand to each other; 0 without terms or text."""
    import pandas as pd

    return pd.Series([density(list(ts), body.lower()) if ts is not None and len(ts) and body else 0.0 for ts, body in zip(terms, texts)], dtype=float)


def _collapsed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def paragraphs(body: Column) -> Column:
    """Paragraphs of twenty characters or more, each also without blanks."""
    kept = F.filter(F.split(body, r"\n\s*\n|\n(?=#{1,3}\s)|\n(?=[-*]\s)"), lambda p: F.length(T.strip(p)) >= 20)
    return F.transform(kept, lambda p: F.struct(F.lower(p).alias("low"), _collapsed(F.lower(p)).alias("flat")))


#: Queries that are answered from one row of a text at most, about.
ASKERS = 1000


def _of_text(x: dict, asks: list[dict]) -> list[tuple]:
    """R11b to R11i of one text for each query that asks for it; what is found of a term serves all of them."""
    body, flat, tokens, again = x["body"], x["flat"], set(x["tokens"]), x["body"].lower()
    seen: dict[str, tuple] = {}
    paras: dict[str, set[int]] = {}
    at: dict[str, np.ndarray] = {}
    out = []
    for a in asks:
        terms, weights, total = a["terms"], a["idf"], 0.0
        sums = [0.0, 0.0, 0.0]
        for t, w in zip(terms, weights):
            if t not in seen:
                seen[t] = (t in tokens or t in flat, t in x["low_title"], t in x["head"] or t in x["head_flat"])
            total += w
            for i, has in enumerate(seen[t]):
                sums[i] += w if has else 0.0
        tfidf, title, position = (v / total if total > 0 else 0.0 for v in sums)
        wanted = a["wanted"]
        coverage = sum(e in body or e in flat for e in wanted) / len(wanted) if wanted else tfidf
        phrase = 1.0 if a["plain"] in body or a["plain_flat"] in flat else 0.0
        together = density(terms, again, at) if terms and again else 0.0
        # R11i: the best paragraph's share of the terms of two or more characters, and of rare single ones
        rare = {t for t, w in zip(terms, weights) if len(t) == 1 and w > 3.0}
        high, counts = [t for t in a["runs"] if len(t) >= 2 or t in rare], Counter()
        for t in high:
            if t not in paras:
                paras[t] = {i for i, p in enumerate(x["paras"]) if t in p["low"] or t in p["flat"]}
            counts.update(paras[t])
        out.append((tfidf, coverage, phrase, title, position, together, max(counts.values()) / len(high) if counts else 0.0))
    return out


def signals(pool: DataFrame, docs: DataFrame, queries: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, signals...): R11b to R11i for each document of each query's pool.

    ``pool`` is a ranked list, ``docs`` (doc_id, title, raw, page_type).  The queries come to the text: it is read, cleaned
    and cut once for all queries (``ASKERS`` of them) in whose pools it is, however long it is.
    """
    low = F.lower("query")
    q = queries.select("query_id", T.query_terms(F.col("query")).alias("terms"), F.transform(T.rerank_entities(F.col("query")), F.lower).alias("wanted"), F.array_distinct(T.all_matches(low, f"[{T.CJK}]+|[a-zA-Z0-9_.-]+")).alias("runs"), T.clean_markdown(low).alias("plain"))
    q = q.withColumn("plain_flat", _collapsed(F.col("plain")))
    terms = q.select("query_id", F.explode("terms").alias("term"))
    weights = terms.join(idf(docs, terms, frequencies), "term").groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "idf")))).alias("idf"))
    q = q.join(weights, "query_id", "left").withColumn("idf", F.transform("terms", lambda t: F.coalesce(F.try_element_at("idf", t), F.lit(0.0))))
    n = pool.groupBy("query_id").agg(F.max("rank").alias("n"))
    parts = pool.groupBy("doc_id").agg(F.ceil(F.count("*") / ASKERS).alias("parts"))
    asks = pool.select("query_id", "doc_id", "rank").join(n, "query_id").join(q, "query_id").join(parts, "doc_id")
    asks = asks.groupBy("doc_id", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("query_id", "rank", "n", "terms", "idf", "wanted", "runs", "plain", "plain_flat")).alias("asks"))
    x = docs.select("doc_id", "title", "raw", "page_type").join(parts.select("doc_id"), "doc_id", "left_semi")
    x = x.select("doc_id", "page_type", F.lower(F.coalesce("title", F.lit(""))).alias("low_title"), T.clean_markdown(F.lower(F.coalesce("raw", F.lit("")))).alias("body"))
    # written out: every signal reads the body, and an inlined expression would be computed anew for each of them
    x = spread_rows(cut_lineage(x).join(asks, "doc_id"))
    head = F.substring(F.col("body"), F.lit(1), F.greatest(F.lit(200), F.floor(F.greatest(F.length("body"), F.lit(1)) / 5)).cast("int"))
    x = x.select("doc_id", "page_type", "asks", "low_title", "body", _collapsed(F.col("body")).alias("flat"), F.array_distinct(T.rerank_tokens(F.col("body"))).alias("tokens"), head.alias("head"), _collapsed(head).alias("head_flat"), paragraphs(F.col("body")).alias("paras"))
    found = ("tfidf", "coverage", "phrase", "title", "position", "together", "density")
    schema = StructType([queries.schema["query_id"], docs.schema["doc_id"], pool.schema["rank"], StructField("n", pool.schema["rank"].dataType), docs.schema["page_type"], *(StructField(c, DoubleType()) for c in found)])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            asks = batch.column("asks").flatten()
            names = ("low_title", "body", "flat", "tokens", "head", "head_flat", "paras")
            for i in range(batch.num_rows):
                asked = batch.column("asks")[i].as_py()
                at += [i] * len(asked)
                rows += _of_text({c: batch.column(c)[i].as_py() for c in names}, asked)
            of = lambda c: batch.column(c).take(pa.array(at, pa.int64()))
            columns = [asks.field("query_id"), of("doc_id"), asks.field("rank"), asks.field("n"), of("page_type"), *(pa.array([r[j] for r in rows], pa.float64()) for j in range(len(found)))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    x = x.mapInArrow(run, schema)
    return x.select("query_id", "doc_id", "rank", "tfidf", "page_type", "coverage", "phrase", "title", "position", "together", (1.0 - (F.col("rank") - 1) / F.col("n")).alias("original"), "density")


def fuse_signals(found: DataFrame) -> DataFrame:
    """R11j: (query_id, doc_id, score)."""
    base = sum((F.col(c) * v for c, v in WEIGHTS.items()), F.lit(0.0))
    weak = (F.col("page_type") == "entity") & ~((F.col("phrase") > 0.5) | (F.col("coverage") > 0.7))
    return found.select("query_id", "doc_id", F.round(F.when(weak, base * 0.5).otherwise(base) + F.col("density") * DENSITY_BONUS, 4).alias("score"))


def rerank(pool: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10, frequencies: DataFrame | None = None) -> DataFrame:
    """The pool's best k by the fused signals."""
    return top_k(fuse_signals(signals(pool, docs, queries, frequencies)), k)
