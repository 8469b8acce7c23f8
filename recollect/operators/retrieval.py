"""Indexes, ranking and fusion over batches of queries.

``docs`` is (doc_id string, title, text, page_type), ``queries`` (query_id, query).  Every ranked
list is (query_id, doc_id, score, rank); order is score descending, then doc_id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from recollect.functions import text as T
from recollect.functions.arrow import task_mapper
from recollect.session import cut_lineage

K1, B = 1.5, 0.75
RRF_K = 60


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query, ranked.

    The rank filter makes Spark keep k rows per query and partition before the shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- R1, R3: index ----------------------------------------------------------------------


def index_documents(sources: DataFrame, entities: DataFrame | None = None, facts: bool = False) -> DataFrame:
    """(doc_id, title, text, raw, page_type) of sources, optional fact children and entities.

    ``text`` is cleaned for BM25 and vectors, ``raw`` is what exact search reads.  Sources are
    (id, title, content), entities (id, name, summary, claims array<string>).
    """
    content = F.coalesce("content", F.lit(""))
    out = sources.select(
        F.col("id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), T.clean_for_index(content).alias("text"), content.alias("raw"), F.lit("source").alias("page_type")
    )
    if facts:
        children = sources.select("id", "title", F.posexplode(T.incidental_facts(content)).alias("n", "fact"))
        out = out.unionByName(
            children.select(F.concat("id", F.lit("#fact_"), "n").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.col("fact").alias("text"), F.col("fact").alias("raw"), F.lit("fact").alias("page_type"))
        )
    if entities is not None:
        page = F.concat_ws("\n", F.col("name"), F.coalesce("summary", F.lit("")), F.array_join(F.coalesce("claims", F.array().cast("array<string>")), "\n"))
        out = out.unionByName(entities.select(F.col("id").alias("doc_id"), F.col("name").alias("title"), page.alias("text"), page.alias("raw"), F.lit("entity").alias("page_type")))
    return out.dropDuplicates(["doc_id"])


#: Documents of one block of an index, about; and tokens after which a block ends.
BLOCK_DOCS, BLOCK_TOKENS = 32_768, 6_000_000


@dataclass(frozen=True)
class SearchIndex:
    """What BM25 and reranking know of a set of documents, stored once and read by every query.

    ``docs`` is what was indexed, ``blocks`` (n, tokens, docs, terms, postings) inverted blocks of documents,
    see ``index_blocks``, ``terms`` (term, df), ``stats`` one row of the number of documents and their
    mean length, ``frequencies`` (term, df) of the reranker's tokens.
    """

    docs: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    frequencies: DataFrame | None = None


def _packed(columns: dict[str, pa.Array]) -> bytes:
    """An Arrow table as compressed bytes."""
    t, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(t.column(name).chunks) if t.num_rows else pa.array([], t.schema.field(name).type)


def _block(batches: list[pa.RecordBatch]) -> list:
    """One block of (doc_id, low, tokens) batches; its documents are numbered in the order of their ids."""
    ids, lows, lists = (pa.concat_arrays([b.column(i) for b in batches]) for i in range(3))
    order, n = pc.sort_indices(ids), len(ids)
    number = np.empty(n, np.int64)
    number[order.to_numpy()] = np.arange(n)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    # one number for each pair of term and document; equal ones are counted
    held, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(number, lengths), return_counts=True)
    term, doc = np.divmod(held, n)
    df = np.bincount(term, minlength=len(coded.dictionary))
    docs = {"doc_id": ids.take(order), "low": lows.take(order), "dl": pa.array(lengths[order.to_numpy()].astype(np.int32))}
    return [n, int(lengths.sum()), _packed(docs), _packed({"term": coded.dictionary, "df": pa.array(df.astype(np.int32))}), _packed({"doc": pa.array(doc.astype(np.int32)), "tf": pa.array(tf.astype(np.int32))})]


def index_blocks(docs: DataFrame) -> DataFrame:
    """(n, tokens, docs, terms, postings): the documents in blocks where they stand, nothing is shuffled.

    ``docs`` packs (doc_id, low, dl) in the order of the ids, low the text in lower case and dl its number of
    tokens, ``terms`` (term, df), ``postings`` (doc, tf) term by term, doc the document's place in its block.
    """
    text = F.coalesce("text", F.lit(""))
    schema = StructType([StructField("n", LongType()), StructField("tokens", LongType()), *(StructField(c, BinaryType()) for c in ("docs", "terms", "postings"))])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, tokens = [], 0, 0
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(_block(kept), out)], schema=out)
        for batch in batches:
            if batch.num_rows:
                kept.append(batch)
                rows, tokens = rows + batch.num_rows, tokens + len(batch.column(2).flatten())
                if rows >= 2 * BLOCK_DOCS or tokens >= BLOCK_TOKENS:
                    yield packed()
                    kept, rows, tokens = [], 0, 0
        if kept:
            yield packed()

    return docs.select("doc_id", F.lower(text).alias("low"), T.bm25_tokens(text).alias("tokens")).mapInArrow(run, schema)


def _block_terms(blocks: DataFrame) -> DataFrame:
    """(term, df) of every block."""
    schema = StructType([StructField("term", StringType()), StructField("df", LongType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                t = _unpacked(data)
                yield pa.RecordBatch.from_arrays([_column(t, "term").cast(out[0].type), _column(t, "df").cast(out[1].type)], schema=out)

    return blocks.select("terms").mapInArrow(run, schema)


def build_index(docs: DataFrame, frequencies: bool = True) -> SearchIndex:
    """Tokenises the documents once and stores the result in the session's shared folder."""
    parallel = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // BLOCK_DOCS))
    # large blocks: each one is asked every query
    stored = cut_lineage(index_blocks(docs.coalesce(parallel)))
    terms = cut_lineage(_block_terms(stored).groupBy("term").agg(F.sum("df").alias("df")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    stats = cut_lineage(stored.agg(total("n").alias("n"), (total("tokens") / F.when(total("n") > 0, total("n"))).alias("avg_dl")))
    df = cut_lineage(term_frequencies(docs)) if frequencies else None
    return SearchIndex(docs, stored, terms, stats, df)


def term_frequencies(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, df): in how many documents each of the reranker's tokens stands."""
    held = docs.select(F.explode(F.array_distinct(T.rerank_tokens(F.coalesce("raw", F.lit(""))))).alias("term"))
    if terms is not None:
        held = held.join(terms.select("term").distinct(), "term", "left_semi")
    return held.groupBy("term").agg(F.count("*").alias("df"))


# --- substrings -------------------------------------------------------------------------

#: Characters of all distinct terms that are sent to every task; with more they are joined.
SENT_CHARS = 4_000_000


def find_terms(docs: DataFrame, terms: DataFrame, text: str = "text", sent: int = SENT_CHARS) -> DataFrame:
    """(doc_id, low, count, pos): which of the terms, in lower case, stand in which documents.

    ``terms`` is (low).  ``count`` is the number of occurrences that don't overlap, ``pos`` the first,
    from 0.  The distinct terms of a query set are few: if they fit ``sent`` characters, one
    automaton of all of them reads every text once.  Beyond that they meet the texts by
    their rarest trigram, in a join.
    """
    wanted = terms.where("low <> ''").select("low").distinct()
    if wanted.agg(F.coalesce(F.sum(F.length("low")), F.lit(0))).first()[0] > sent:
        return _find_by_grams(docs, wanted, text)
    # at most ``sent`` characters, sent once to each executor
    shared = docs.sparkSession.sparkContext.broadcast([r.low for r in wanted.collect()])
    body = docs.where(F.col(text).isNotNull()).select("doc_id", F.lower(text).alias("body"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        import ahocorasick

        words = shared.value
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()

        def f(keys: list, bodies: list):
            out: tuple[list, list, list, list] = ([], [], [], [])
            for key, body in zip(keys, bodies):
                found: dict[str, list[int]] = {}
                for last, w in automaton.iter(body) if words else ():
                    start = last - len(w) + 1
                    seen = found.get(w)
                    if seen is None:
                        found[w] = [1, start, last]
                    elif start > seen[2]:
                        seen[0] += 1
                        seen[2] = last
                for w, (n, first, _) in found.items():
                    for column, value in zip(out, (key, w, n, first)):
                        column.append(value)
            return out

        return f

    return task_mapper(body, [F.col("doc_id"), F.col("body")], f"doc_id {kind}, low string, count bigint, pos int", make)


def _find_by_grams(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    sized = wanted.withColumn("g", F.least(F.length("low"), F.lit(3)))
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, n))
    grams = sized.select("low", F.explode(F.array_distinct(pieces("low", F.col("g")))).alias("gram"))
    body = docs.where(F.col(text).isNotNull()).select("doc_id", F.lower(text).alias("body"))
    none = F.array().cast("array<string>")
    of = lambda n: F.when(F.length("body") >= n, F.array_distinct(pieces("body", F.lit(n)))).otherwise(none)
    held = body.select("doc_id", F.explode(F.concat(of(3), of(2), of(1))).alias("gram")).join(grams.select("gram").distinct(), "gram", "left_semi")
    common = held.groupBy("gram").agg(F.count("*").alias("c"))
    need = grams.groupBy("low").agg(F.count("*").alias("need"))
    key = grams.join(common, "gram").groupBy("low").agg(F.min(F.struct("c", "gram"))["gram"].alias("gram"), F.count("*").alias("have"))
    key = key.join(need, "low").where("have = need").select("low", "gram")
    found = held.join(key, "gram").select("doc_id", "low").join(body, "doc_id").where(F.col("body").contains(F.col("low")))
    times = ((F.length("body") - F.length(F.replace("body", "low", F.lit("")))) / F.length("low")).cast("bigint")
    return found.select("doc_id", "low", times.alias("count"), (F.instr("body", F.col("low")) - 1).alias("pos"))


# --- R2: BM25 ---------------------------------------------------------------------------


#: Tokens of a query set that are sent to every task at once; a larger set is searched in several passes.
SENT_TERMS = 2_000_000


def bm25(docs: DataFrame | SearchIndex, queries: DataFrame, k: int = 10, rounded: int = 4, sent: int = SENT_TERMS) -> DataFrame:
    """R2: the k best documents of each query.

    Query tokens that repeat count again.  A document that holds the whole query, whatever
    the case, is boosted by 1.5, and by 1.3 more if the query has six or more characters.
    Null texts match nothing.

    ``docs`` is a stored index, or documents, of which one is built.  The queries go to every block
    of the index, which scores all of its documents for one query after the other and passes on its best;
    pairs of query and document that are not among them leave no task.
    """
    index = docs if isinstance(docs, SearchIndex) else build_index(docs, frequencies=False)
    size = queries.agg(F.coalesce(F.sum(F.size(T.bm25_tokens(F.coalesce("query", F.lit(""))))), F.lit(0)).alias("n")).first().n
    slices = max(1, -(-size // max(1, sent)))
    found = None
    for n in range(slices):
        part = queries if slices == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == n)
        one = _bm25_pass(index, part, k, rounded)
        one = one if slices == 1 else cut_lineage(one)
        found = one if found is None else found.unionByName(one)
    return found


@dataclass(frozen=True)
class _Asked:
    """Different queries as every task gets them: ``terms`` and, from ``starts`` on, each query's (``term``, ``weight``)."""

    lows: list[str]
    terms: pa.Array
    starts: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    #: Terms that a text that holds the whole query has for certain.
    sure: list[np.ndarray]
    avg_dl: float


def _inner(low: str) -> set[str]:
    """Tokens that any text which holds ``low`` has too: all but Latin ones at its ends, which may go on there."""
    return {m.group() for m in re.finditer(T.TOKEN, low) if m.group() >= T.FIRST_CJK or (m.start() and m.end() < len(low))}


def _bm25_pass(index: SearchIndex, queries: DataFrame, k: int, rounded: int) -> DataFrame:
    spark = queries.sparkSession
    asked = queries.where("query is not null").select("query_id", F.lower("query").alias("low"), T.bm25_tokens(F.col("query")).alias("tokens")).toArrow()  # at most SENT_TERMS tokens
    tokens: dict[str, list[str]] = {}
    for low, ts in zip(asked.column("low").to_pylist(), asked.column("tokens").to_pylist()):
        if ts:
            tokens.setdefault(low, ts)
    wanted = queries.select(F.explode(T.bm25_tokens(F.col("query"))).alias("term")).distinct()
    df = dict(map(tuple, index.terms.join(F.broadcast(wanted), "term", "left_semi").collect()))
    stats = index.stats.first()
    number, starts, term, weight, sure = {t: i for i, t in enumerate(df)}, [0], [], [], []
    for low, ts in tokens.items():
        for t, times in Counter(ts).items():
            if t in df:
                term.append(number[t])
                weight.append(times * math.log((stats.n - df[t] + 0.5) / (df[t] + 0.5) + 1.0))
        starts.append(len(term))
        inner = _inner(low)
        sure.append(np.array([number.get(t, -1) for t in inner], np.int64))
    shared = spark.sparkContext.broadcast(_Asked(list(tokens), pa.array(list(df), pa.string()), np.array(starts), np.array(term, np.int64), np.array(weight), sure, stats.avg_dl or 1.0))
    kind = index.docs.schema["doc_id"].dataType
    schema = StructType([StructField("query_id", IntegerType()), StructField("doc_id", kind), StructField("score", DoubleType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        floor = np.zeros(len(a.lows))  # scores that k documents have reached in the task
        for batch in batches:
            for row in range(batch.num_rows):
                q, ids, s = _best_of_block(a, *(_unpacked(c[row]) for c in batch.columns), k, rounded, floor)
                yield pa.RecordBatch.from_arrays([pa.array(q, out[0].type), ids.cast(out[1].type), pa.array(s, out[2].type)], schema=out)

    best = top_k(index.blocks.select("docs", "terms", "postings").mapInArrow(run, schema), k)
    place = {low: i for i, low in enumerate(tokens)}
    keys = pa.table({"number": pa.array([place.get(x) for x in asked.column("low").to_pylist()], pa.int32()), "query_id": asked.column("query_id")})
    # queries of the same text share one list
    keys = spark.createDataFrame(keys, StructType([StructField("number", IntegerType()), queries.schema["query_id"]])).where("number is not null")
    return best.withColumnRenamed("query_id", "number").join(F.broadcast(keys), "number").select("query_id", "doc_id", "score", "rank")


def _found_in(ordered: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each of ``some`` in an ordered list that is not empty, and whether it is there."""
    place = np.minimum(np.searchsorted(ordered, some), len(ordered) - 1)
    return place, ordered[place] == some


def _holding(a: _Asked, lows: list[str], at: np.ndarray, sizes: np.ndarray, listed: Callable) -> list[np.ndarray]:
    """For each query the documents of a block that hold it whole.

    They are among those that have its inner tokens; queries without any are looked for in every text.
    """
    none = np.empty(0, np.int64)
    out, loose = [none] * len(a.lows), {}
    for i, low in enumerate(a.lows):
        if not len(a.sure[i]):
            loose[low] = i
            continue
        here = np.where(a.sure[i] >= 0, at[a.sure[i]], -1) if len(at) else a.sure[i] * 0 - 1
        if here.min() < 0:
            continue
        here = here[np.argsort(sizes[here], kind="stable")[:4]]
        some = listed(here[0])
        for t in here[1:]:
            if len(some) > 20:
                some = some[_found_in(listed(t), some)[1]]
        out[i] = np.array([d for d in some.tolist() if low in lows[d]], np.int64)
    if loose:
        import ahocorasick

        automaton, found = ahocorasick.Automaton(), {}
        for low, i in loose.items():
            automaton.add_word(low, i)
        automaton.make_automaton()
        for d, body in enumerate(lows):
            for i in {i for _, i in automaton.iter(body)}:
                found.setdefault(i, []).append(d)
        for i, ds in found.items():
            out[i] = np.array(ds, np.int64)
    return out


def _best_of_block(a: _Asked, docs: pa.Table, terms: pa.Table, postings: pa.Table, k: int, rounded: int, floor: np.ndarray) -> tuple[list, pa.Array, list]:
    """(query numbers, ids, scores): each query's best k documents of a block, without those below its floor, which rises."""
    n, unit = docs.num_rows, 10.0**rounded
    at = pc.index_in(a.terms, value_set=_column(terms, "term").cast(pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(_column(terms, "df").to_numpy()))
    doc, tf = (_column(postings, c).to_numpy() for c in ("doc", "tf"))
    norm = K1 * (1 - B + B * _column(docs, "dl").to_numpy() / a.avg_dl)
    gain = tf * (K1 + 1) / (tf + norm[doc])
    sizes = np.diff(ends)
    most = np.maximum.reduceat(gain, ends[:-1]) if len(gain) else gain
    hold = _holding(a, _column(docs, "low").to_pylist(), at, sizes, lambda t: doc[ends[t] : ends[t + 1]])
    whole: dict[int, np.ndarray] = {}  # gains of terms that stand in an eighth of the documents or more
    score, step = np.zeros(n), np.empty(n)
    lots = max(64, 8 * k)
    qs, ds, ss = [], [], []

    def reached() -> float:
        """A score that k documents have: the k-th of the greatest of many parts."""
        if n < 8 * lots:
            return 0.0
        tops = score[: n // lots * lots].reshape(lots, -1).max(axis=1)
        return np.partition(tops, lots - k)[lots - k]

    for i, low in enumerate(a.lows):
        j = np.arange(a.starts[i], a.starts[i + 1])
        t = at[a.term[j]]
        t, w = t[t >= 0], a.weight[j][t >= 0]
        if not len(t):
            continue
        bound = w * most[t]
        first = np.argsort(-bound, kind="stable")
        t, w, rest = t[first].tolist(), w[first].tolist(), np.append(np.cumsum(bound[first][::-1])[::-1], 0.0).tolist()
        score[:] = 0.0
        least, some, m = floor[i], None, 0
        # the terms that can add most come first; once the others cannot lift a document to the k best, only those near them get the rest
        for m in range(len(t)):
            x, y = ends[t[m]], ends[t[m] + 1]
            if m and (y - x) * 32 >= n:
                if rest[m] >= least - 1.5 / unit:
                    least = max(least, reached())
                if rest[m] < least - 1.5 / unit:
                    near = np.flatnonzero(score >= least - 1.5 / unit - rest[m] - 1e-9)
                    if len(near) * 16 < n:
                        some = np.union1d(near, hold[i]) if len(hold[i]) else near
                        break
            if (y - x) * 8 < n:
                score[doc[x:y]] += w[m] * gain[x:y]
                continue
            if t[m] not in whole:
                whole[t[m]] = np.zeros(n)
                whole[t[m]][doc[x:y]] = gain[x:y]
            np.multiply(whole[t[m]], w[m], out=step)
            score += step
        if some is None:
            if len(hold[i]):
                score[hold[i]] *= 1.5 * 1.3 if len(low) >= 6 else 1.5
            least = max(least, reached())
            d = np.flatnonzero(score >= least - 1.5 / unit) if least > 0 else np.flatnonzero(score)
            s = score[d]
        else:
            d, s = some, score[some]
            at32 = some.astype(np.int32)
            for m in range(m, len(t)):
                x, y = ends[t[m]], ends[t[m] + 1]
                if t[m] in whole:
                    s += w[m] * whole[t[m]][some]
                else:
                    place, there = _found_in(doc[x:y], at32)
                    s += np.where(there, w[m] * gain[x:y][place], 0.0)
            if len(hold[i]):
                s[np.searchsorted(some, hold[i])] *= 1.5 * 1.3 if len(low) >= 6 else 1.5
        d, s = d[s > 0], s[s > 0]
        s = np.floor(s * unit + 0.5) / unit
        if len(d) > k:
            first = np.lexsort((d, -s))[:k]
            d, s = d[first], s[first]
        if len(d) == k:
            floor[i] = max(floor[i], s.min())
        else:
            d, s = d[s >= floor[i]], s[s >= floor[i]]
        qs.append(np.full(len(d), i))
        ds.append(d)
        ss.append(s)
    q, d, s = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (qs, ds, ss))
    return q, _column(docs, "doc_id").take(pa.array(d, pa.int64())), s


# --- R4: exact --------------------------------------------------------------------------


def exact(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text") -> DataFrame:
    """Documents that hold the queries' exact terms as substrings."""
    terms = queries.select("query_id", F.posexplode(T.exact_terms(F.col("query"))).alias("n", "term")).withColumn("low", F.lower("term"))
    found = find_terms(docs, terms.select("low"), text)
    term_score = (F.col("count") * 2.0 + 1.0 / (1.0 + F.col("pos") / 1000.0)) * (1.0 + F.length("low") / 20.0)
    total = terms.join(found, "low").groupBy("query_id", "doc_id").agg(F.sum(term_score).alias("s"), F.count("*").alias("m"), F.min(F.struct("n", "term"))["term"].alias("term"))
    return top_k(total.select("query_id", "doc_id", F.round(F.col("s") * (1.0 + 0.3 * (F.col("m") - 1)), 4).alias("score"), "term"), k)


# --- R5: vectors ------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))


#: Bytes of query vectors that one plan sends to its tasks; a larger query set is split by hash.
SENT_VECTORS = 64_000_000


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; rows without a length stay zero."""
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, n, out=np.zeros_like(rows), where=n > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column, none of them null, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class _Best:
    """The best ``k`` (score, id) of each query over all that is shown; ties by id."""

    def __init__(self, k: int, queries: int):
        self.k, self.floor = k, np.zeros(queries)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def see(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row for each query and a column for each id."""
        n = scores.shape[1]
        if n > self.k:
            self.floor = np.maximum(self.floor, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        q, d = np.nonzero((scores >= self.floor[:, None]) & (scores > 0))
        self.parts.append((q, ids[d], scores[q, d]))
        self.held += len(q)
        if self.held > 4 * self.k * max(1, len(self.floor)):
            self.parts = [self.best()]
            self.held = len(self.parts[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, s = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, -s, q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.searchsorted(q, np.arange(len(self.floor)))
        kept = np.arange(len(q)) - first[q] < self.k
        return q[kept], ids[kept], s[kept]


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of unit rows, rounded as they are ranked, so that ties are broken by id only."""
    return np.round(np.round(q @ v.T, 10), 4)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 256, exclude_self: bool = False, sent: int = SENT_VECTORS) -> DataFrame:
    """The k nearest vectors of each query by cosine, only positive ones.

    ``vectors`` is (doc_id, vector), ``queries`` (query_id, vector), all of one length; null vectors
    match nothing.  A stated query set against all rows: the queries go to every task once,
    each batch of vectors meets them in blocks of ``block``, and a task passes on its best
    per query.  Query sets beyond ``sent`` bytes are searched in several such passes.
    """
    vectors, queries = vectors.where("vector is not null"), queries.where("vector is not null")
    size = queries.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("n")).first().n * 8
    slices = max(1, -(-size // sent))
    found = None
    for n in range(slices):
        part = queries if slices == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == n)
        one = _search_slice(vectors, part, k + exclude_self, block)
        found = one if found is None else found.unionByName(one)
    if exclude_self:
        found = found.where("query_id <> doc_id")
    return top_k(found, k)


def _search_slice(vectors: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    rows = queries.collect()  # at most SENT_VECTORS bytes of vectors
    names = vectors.sparkSession.sparkContext.broadcast(([r.query_id for r in rows], _unit(np.array([r.vector for r in rows], dtype=float)) if rows else np.zeros((0, 0))))
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("doc_id", vectors.schema["doc_id"].dataType), StructField("score", DoubleType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = names.value
        best = [_Best(k, len(q[a : a + block])) for a in range(0, len(q), block)]
        seen = False
        for batch in batches:
            if batch.num_rows and len(q):
                docs, v, seen = batch.column(0).to_numpy(zero_copy_only=False), _unit(_matrix(batch.column(1))), True
                for b, a in zip(best, range(0, len(q), block)):
                    b.see(_scores(q[a : a + block], v), docs)
        for b, a in zip(best, range(0, len(q), block)) if seen else ():
            at, docs, s = b.best()
            yield pa.RecordBatch.from_arrays([pa.array([ids[a + i] for i in at], out[0].type), pa.array(docs, out[1].type), pa.array(s, out[2].type)], schema=out)

    return vectors.select("doc_id", "vector").mapInArrow(run, schema)


#: The approximate index: vectors its cells are fitted on, and vectors in one part of a cell on average.
FITTED, CELL_PART = 20_000, 4096


@dataclass(frozen=True)
class VectorIndex:
    """Every vector in the cell of its nearest centroid: (cell, part, doc_id, vector).

    A cell is cut into parts by hash, so a crowded one is no single group.  ``probes`` is how many
    cells a query must look into for the recall asked for, as measured on the fitted vectors.
    """

    centroids: np.ndarray
    cells: DataFrame
    parts: DataFrame
    probes: int


def _nearest(centroids: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each unit row."""
    s = v @ centroids.T
    return np.argsort(-s, axis=1, kind="stable")[:, :n]


def _in_cells(rows: DataFrame, key: str, centroids: np.ndarray, n: int) -> DataFrame:
    """(cell, key, vector): each row in its ``n`` nearest cells."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = StructType([StructField("cell", IntegerType()), StructField(key, rows.schema[key].dataType), StructField("vector", rows.schema["vector"].dataType)])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _nearest(shared.value, _unit(_matrix(batch.column(1))), n)
                take = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), batch.column(0).take(take), batch.column(1).take(take).cast(out[2].type)], schema=out)

    return rows.select(key, "vector").mapInArrow(run, schema)


def _probes(centroids: np.ndarray, v: np.ndarray, recall: float, k: int = 10, asked: int = 500) -> int:
    """The least number of nearest cells that hold that share of the ``k`` nearest rows, for up to ``asked`` of the rows."""
    q = v[: asked]
    s = q @ v.T
    s[np.arange(len(q)), np.arange(len(q))] = -2
    k = min(k, len(v) - 1)
    if k < 1:
        return len(centroids)
    nearest = np.argpartition(-s, k - 1, axis=1)[:, :k]
    order = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)  # the place of each cell for each query
    places = np.take_along_axis(order, _nearest(centroids, v, 1)[:, 0][nearest], axis=1)
    held = np.cumsum(np.bincount(places.ravel(), minlength=len(centroids))) / places.size
    return int(np.searchsorted(held, recall) + 1)


def vector_index(vectors: DataFrame, cells: int | None = None, fitted: int = FITTED, rounds: int = 10, seed: int = 7, recall: float = 0.95) -> VectorIndex:
    """An inverted file: spherical k-means on at most ``fitted`` vectors chosen by hash; every vector is indexed.

    By default there are as many cells as the root of the fitted vectors.
    """
    vectors = vectors.where("vector is not null")
    sample = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted).select("vector").collect()
    if not sample:
        raise ValueError("no vectors to index")
    v = _unit(np.array([r.vector for r in sample], dtype=float))
    n = min(len(v), cells or max(1, int(len(v) ** 0.5)))
    centroids = v[np.random.default_rng(seed).choice(len(v), n, replace=False)]
    for _ in range(rounds):
        near = _nearest(centroids, v, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, v)
        met = np.bincount(near, minlength=n) > 0
        centroids = np.where(met[:, None], _unit(sums), centroids)
    rows = _in_cells(vectors, "doc_id", centroids, 1)
    rows = cut_lineage(rows.withColumn("h", F.xxhash64("doc_id")))
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / CELL_PART).cast("int").alias("parts"))
    parted = rows.join(parts, "cell").select("cell", F.pmod("h", F.col("parts")).cast("int").alias("part"), "doc_id", "vector")
    return VectorIndex(centroids, cut_lineage(parted), cut_lineage(parts), min(n, _probes(centroids, v, recall)))


def vector_search_near(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, exclude_self: bool = False) -> DataFrame:
    """R5, approximately: the k nearest vectors among those in each query's ``probes`` nearest cells.

    By default as many as the index needs for its recall; all cells give the exact result.
    """
    probes = probes or index.probes
    probing = _in_cells(queries.where("vector is not null"), "query_id", index.centroids, min(probes, len(index.centroids)))
    probing = probing.join(index.parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "vector")
    kept = k + exclude_self
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("doc_id", index.cells.schema["doc_id"].dataType), StructField("score", DoubleType())])
    out = to_arrow_schema(schema)

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return out.empty_table()
        v, q = (_unit(_matrix(t.column("vector").combine_chunks())) for t in (docs, asked))
        best = _Best(kept, len(q))
        best.see(_scores(q, v), docs.column("doc_id").to_numpy())
        at, ids, s = best.best()
        return pa.Table.from_arrays([asked.column("query_id").take(pa.array(at)), pa.array(ids, out[1].type), pa.array(s, out[2].type)], schema=out)

    found = index.cells.groupBy("cell", "part").cogroup(probing.groupBy("cell", "part")).applyInArrow(run, schema)
    if exclude_self:
        found = found.where("query_id <> doc_id")
    return top_k(found, k)


# --- R8, R10: fusion --------------------------------------------------------------------


def rrf(lists: list[tuple[DataFrame, float]], k: int = 10, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists."""
    union = None
    for ranked, weight in lists:
        part = ranked.select("query_id", "doc_id", (F.lit(float(weight)) / (rrf_k + F.col("rank"))).alias("s"))
        union = part if union is None else union.unionByName(part)
    return top_k(union.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score")), k)


def by_parent(ranked: DataFrame) -> DataFrame:
    """Fact children as their parents; the first of a parent stays, ranks close up."""
    parent = F.substring_index("doc_id", "#fact_", 1)
    first = Window.partitionBy("query_id", "parent").orderBy("rank")
    kept = ranked.withColumn("parent", parent).withColumn("n", F.row_number().over(first)).where("n = 1")
    again = Window.partitionBy("query_id").orderBy("rank")
    return kept.select("query_id", F.col("parent").alias("doc_id"), "score", F.row_number().over(again).alias("rank"))
