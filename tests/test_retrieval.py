import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import evaluate, graph, leader, rerank, retrieval
from recollect.plans import engine

DOCS = [
    ("a", "Alpha", "the quick brown fox jumps over retry_flag 3000", "source"),
    ("b", "Beta", "a quick quick fox and a lazy dog", "source"),
    ("c", "Gamma", "nothing to see here retry_flag RETRY_FLAG", "source"),
    ("d", "Delta", "成本中心 凭证生成", "source"),
    ("e", "Null", None, "source"),
    ("f", "Empty", "", "source"),
]


def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id string, title string, text string, page_type string")
    return df.withColumn("raw", F.coalesce("text", F.lit("")))


def queries(spark, *qs):
    return spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "query_id int, query string")


def brute_bm25(query, k=10):
    def tok(t):
        return t.lower().split()

    body = {d: tok(t) for d, _, t, _ in DOCS[:3]}
    n, avg = 6, sum(len(x) for x in [*body.values(), ["x"] * 17]) / 6
    df = Counter(w for x in body.values() for w in set(x))
    out = {}
    for d, x in body.items():
        tf, s = Counter(x), 0.0
        for w in tok(query):
            if tf[w]:
                idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
                s += idf * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(x) / avg))
        if s:
            if query.lower() in " ".join(x):
                s *= 1.5 * (1.3 if len(query) >= 6 else 1)
            out[d] = round(s, 4)
    return out


def test_bm25_formula_and_boost(spark):
    rows = retrieval.bm25(docs(spark), queries(spark, "quick fox", "lazy dog", "", "absent")).collect()
    got = {(r.query_id, r.doc_id): r.score for r in rows}
    total = docs(spark).select(F.sum(F.size(T.bm25_tokens(F.col("raw"))))).first()[0]
    assert total == 9 + 8 + 6 + 8 + 6  # tokens of a to d, pairs included
    assert {k[0] for k in got} == {0, 1}
    assert got[0, "b"] > got[0, "a"] and (0, "c") not in got
    assert [r["rank"] for r in rows if r.query_id == 0] == [1, 2]


def test_bm25_prunes_without_losing_boosted_documents(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    body = [(f"{i:03}", "", " ".join(rng.choices(words, k=rng.randint(3, 30))), "source") for i in range(200)]
    d = spark.createDataFrame(body, "doc_id string, title string, text string, page_type string")
    qs = [" ".join(rng.choices(words, k=2)) for _ in range(10)]
    got = retrieval.bm25(d, queries(spark, *qs), 3).collect()
    n, toks = len(body), {b[0]: b[2].split() for b in body}
    avg = sum(map(len, toks.values())) / n
    df = Counter(w for x in toks.values() for w in set(x))
    for i, q in enumerate(qs):
        scores = {}
        for k, x in toks.items():
            tf = Counter(x)
            s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(x) / avg)) for w in q.split() if tf[w])
            if s > 0:
                scores[k] = round(s * ((1.95 if len(q) >= 6 else 1.5) if q in " ".join(x) else 1), 4)
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert [(r.doc_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want


def test_bm25_lets_only_each_blocks_best_out(spark, monkeypatch):
    """Every query meets every document by a common word; ties, whole queries and several blocks as by brute force."""
    rng = random.Random(3)
    words = ["the", "axis", "b.c", "成", "本中", "x"]
    body = [(f"{i:03}", " ".join(["the", *rng.choices(words, k=rng.randint(1, 9))])) for i in range(400)] + [("n", None)]
    d = spark.createDataFrame(body, "doc_id string, text string").withColumn("title", F.lit("")).repartition(3)
    q = queries(spark, "the axis", "The", "x the b.c", "the", "本中 成 the", "he axi", "absent", "", "the x axis x")
    tokens = {r.doc_id: r.t for r in d.select("doc_id", T.bm25_tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    asked = {r.query_id: (r.q, r.t) for r in q.select("query_id", F.lower("query").alias("q"), T.bm25_tokens(F.col("query")).alias("t")).collect()}
    df, avg = Counter(w for x in tokens.values() for w in set(x)), sum(map(len, tokens.values())) / len(tokens)
    want = {}
    for i, (low, ts) in asked.items():
        s = {}
        for k, text in body:
            tf = Counter(tokens[k])
            v = sum(math.log((401 - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(tokens[k]) / avg)) for w in ts if tf[w])
            if v > 0:
                s[k] = v * (1 if low not in text.lower() else 1.95 if len(low) >= 6 else 1.5)
        want |= {(i, n): x for n, x in enumerate(sorted(((-round(v, 4), k) for k, v in s.items()))[:5], 1)}
    left = []
    top_k = retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda scored, k: (left.append(scored.count()), top_k(scored, k))[1])
    got = {(r.query_id, r["rank"]): (-r.score, r.doc_id) for r in retrieval.bm25(d, q, 5).collect()}
    assert {k: x[1] for k, x in got.items()} == {k: x[1] for k, x in want.items()} and all(abs(got[k][0] - want[k][0]) < 1e-9 for k in got)
    assert left[0] <= 3 * len(asked) * 5  # before: a row for each query and document with a word in common


def test_exact_against_brute_force(spark):
    rng = random.Random(2)
    parts = ["retry_flag", "3000", "74.5%", "deadbeef01", "凭证生成", "x", "a.b", "foo_bar_baz", " "]
    body = [(str(i), "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(80)] + [("n", None)]
    d = spark.createDataFrame(body, "doc_id string, text string")
    qs = ["retry_flag and 3000", "deadbeef01 凭证生成 foo_bar", "words only", "74.5%"]
    q = queries(spark, *qs)
    terms = {r.query_id: r.t for r in q.select("query_id", T.exact_terms(F.col("query")).alias("t")).collect()}
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.exact(d, q, 1000).collect()}
    want = {}
    for i, ts in terms.items():
        for k, t in body:
            hits = [(w, t.lower().count(w.lower()), t.lower().find(w.lower())) for w in ts if t and w.lower() in t.lower()]
            if hits:
                s = sum((c * 2.0 + 1 / (1 + p / 1000)) * (1 + len(w) / 20) for w, c, p in hits) * (1 + 0.3 * (len(hits) - 1))
                want[i, k] = round(s, 4)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in got) and len(got) > 50
    low = q.select(F.explode(T.exact_terms(F.col("query"))).alias("t")).select(F.lower("t").alias("low")).unionByName(spark.createDataFrame([("x",), ("aa",), ("",)], "low string"))
    d = d.unionByName(spark.createDataFrame([("rep", "aaaaa xx")], "doc_id string, text string"))
    one, many = (sorted(map(tuple, retrieval.find_terms(d, low, sent=n).collect())) for n in (10**6, 0))
    assert one == many and ("rep", "aa", 2, 0) in one


def test_vector_search_blocks_and_zero_vectors(spark):
    rng = random.Random(4)
    vs = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(99, [0.0] * 4)]
    v = spark.createDataFrame(vs, "doc_id int, vector array<double>")
    q = v.where("doc_id % 7 = 0 or doc_id = 99").withColumnRenamed("doc_id", "query_id")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (math.dist(a, [0] * 4) * math.dist(b, [0] * 4) or 1)
    for block in (3, 256):
        got = {}
        for r in retrieval.vector_search(v, q, 4, block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
        for i, a in vs:
            if i % 7 == 0 and i < 60:
                want = sorted(((-round(cos(a, b), 4), j) for j, b in vs if cos(a, b) > 0))[:4]
                assert [(j, s) for _, j, s in sorted(got[i])] == [(j, -s) for s, j in want]
        assert 99 not in got


def test_vector_search_in_many_blocks_and_passes_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 8)), 1)
    x[::50] = x[0]  # ties
    x[5] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "doc_id bigint, vector array<double>").repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(600)] + [(901, None)], "query_id bigint, vector array<double>")
    n = np.linalg.norm(x, axis=1)
    s = np.round(np.round(np.divide(x @ x.T, np.outer(n, n), out=np.zeros((700, 700)), where=np.outer(n, n) > 0), 10), 4)
    want = {i: [(j, s[i, j]) for j in np.lexsort((np.arange(700), -s[i])) if j != i and s[i, j] > 0][:5] for i in range(600)}
    want = {i: x for i, x in want.items() if x}
    for options in ({}, {"block": 64}, {"sent": 8 * 8 * 200}):
        got = {}
        for r in retrieval.vector_search(v, q, 5, exclude_self=True, **options).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert got == want
    assert retrieval.vector_search(v.limit(0), q, 5).count() == 0 and retrieval.vector_search(v, q.limit(0), 5).count() == 0


def test_recall_of_the_vector_index(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    index = retrieval.vector_index(e)
    assert index.cells.count() == e.count() and index.cells.select("doc_id").distinct().count() == e.count()
    exact = {(r.query_id, r.doc_id) for r in retrieval.vector_search(e, q, 10, exclude_self=True).collect()}
    near = {(r.query_id, r.doc_id) for r in retrieval.vector_search_near(index, q, 10, exclude_self=True).collect()}
    recall = len(exact & near) / len(exact)
    assert recall >= 0.9, (recall, index.probes)
    print("recall", recall, "probes", index.probes, "of", len(index.centroids))
    everything = retrieval.vector_search_near(index, q, 10, probes=10_000, exclude_self=True).collect()
    assert {(r.query_id, r.doc_id) for r in everything} == exact


def test_clustered_vectors_need_few_cells(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 4
    x = centres[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id bigint, vector array<double>")
    q = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    index = retrieval.vector_index(v)
    exact = {(r.query_id, r.doc_id) for r in retrieval.vector_search(v, q, 10).collect()}
    near = {(r.query_id, r.doc_id) for r in retrieval.vector_search_near(index, q, 10).collect()}
    assert index.probes <= len(index.centroids) // 4 and len(exact & near) >= 0.9 * len(exact)


def test_rrf_and_parents(spark):
    a = spark.createDataFrame([(0, "x#fact_1", 1), (0, "y", 2)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(0, "x", 1), (0, "y", 3)], "query_id int, doc_id string, rank int")
    fused = retrieval.rrf([(a, 2.0), (b, 1.0)], 10)
    got = {r.doc_id: r.score for r in fused.collect()}
    assert got == {"y": round(2 / 62 + 1 / 63, 6), "x#fact_1": round(2 / 61, 6), "x": round(1 / 61, 6)}
    assert [(r.doc_id, r["rank"]) for r in retrieval.by_parent(fused).orderBy("rank").collect()] == [("y", 1), ("x", 2)]


def test_graph_hops(spark):
    names = spark.createDataFrame([("E1", "Kestrel"), ("E2", "Thistle"), ("E1", "kes")], "entity_id string, name string")
    edges = spark.createDataFrame([("E1", "s1"), ("E1", "s1"), ("E2", "s1"), ("E2", "s2"), (None, "s3")], "entity_id string, source_id string")
    got = {r.doc_id: r.score for r in graph.graph_search(names, edges, queries(spark, "about kestrel"), 10).collect()}
    assert got == {"s1": 2.0, "s2": 0.25}  # two names match; the path by way of E2 counts half of half
    assert graph.graph_search(names, edges, queries(spark, "nobody"), 10).count() == 0


def test_cooccurrence(spark):
    df = spark.createDataFrame([(["ab", "cd"], "ab cd"), (["ab", "zz"], "ab"), ([], "ab"), (["q"], None)], "t array<string>, b string")
    got = [r.v for r in df.select(rerank.cooccurrence(F.col("t"), F.col("b")).alias("v")).collect()]
    assert got[0] == 1.0 and got[1] == 0.25 and got[2] == 0.0 and got[3] == 0.0


def test_density_equals_every_window_tried():
    rng = random.Random(9)
    for terms in (["ab", "b", "cab", "zz"], ["a"], ["ab", "abab"]):
        for size, gap in ((40, 3), (60, 90), (25, 400)):
            text = "".join(rng.choice(["ab", "b", "cab", "x", "a"]) + " " * rng.randint(0, gap) for _ in range(size))
            at = sorted((i, t) for t in terms for i in range(len(text)) if text.startswith(t, i))
            best = 0.0
            for i in range(len(at)):
                ends = [j for j in range(i + 1, len(at))]
                reach = next((n + 1 for n, j in enumerate(ends) if at[j][0] - at[i][0] + 1 > 500), len(ends))
                for j in ends[:reach]:
                    best = max(best, len({t for _, t in at[i : j + 1]}) / (1 + (at[j][0] - at[i][0] + 1) / 200))
            want = min(1.0, len({t for _, t in at}) / len(terms) / 2 + best / 2)
            assert abs(rerank.density(terms, text) - want) < 1e-12


def test_density_of_a_long_text_is_not_quadratic():
    assert rerank.density(["ab", "b", "zz"], "ab " * 100_000) > 0


def test_reranking_reads_a_text_once_for_all_queries(spark, monkeypatch):
    """Before, each query had its own copy of every text of its pool."""
    d = spark.createDataFrame([("long", "T", "the axis_flag " * 9000 + "end_mark", "entity"), ("short", "S", "an axis", "source")], "doc_id string, title string, raw string, page_type string")
    q = queries(spark, *[f"the axis_flag end_mark {i}" for i in range(40)])
    pool = q.select("query_id", F.explode(F.array(F.struct(F.lit("long").alias("doc_id"), F.lit(1).alias("rank")), F.struct(F.lit("short").alias("doc_id"), F.lit(2).alias("rank")))).alias("r")).select("query_id", "r.*")
    held = []
    for name in ("cut_lineage", "spread_rows"):
        monkeypatch.setattr(rerank, name, lambda df, f=getattr(rerank, name): (held.append(df.count()), f(df))[1])
    got = {(r.query_id, r.doc_id): r for r in rerank.signals(pool, d, q).collect()}
    assert len(got) == 80 and max(held) <= 2
    for i in range(40):
        long, short = got[i, "long"], got[i, "short"]
        assert (long.original, short.original) == (1.0, 0.5) and long.together == 1.0 and long.coverage == 1.0 and short.coverage == 0.0 and 0 < long.tfidf < 1
    monkeypatch.setattr(rerank, "ASKERS", 7)
    assert {(r.query_id, r.doc_id): r for r in rerank.signals(pool, d, q).collect()} == got


def test_a_stored_index_gives_the_same_lists(spark):
    x, q = docs(spark), queries(spark, "quick fox quick", "retry_flag 3000", "lazy", "nothing here", "成本中心")
    index = retrieval.build_index(x)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(retrieval.bm25(index, q)) == rows(retrieval.bm25(x, q)) != []
    assert rows(retrieval.bm25(index, q, sent=0)) == rows(retrieval.bm25(x, q, sent=0)) == rows(retrieval.bm25(x, q))
    terms = q.select(F.explode(T.query_terms(F.col("query"))).alias("term"))
    assert rows(rerank.idf(x, terms, index.frequencies)) == rows(rerank.idf(x, terms))
    empty = retrieval.build_index(x.limit(0))
    assert retrieval.bm25(empty, q).count() == 0


def test_engine_end_to_end(spark):
    index = engine.Index(
        retrieval.index_documents(
            spark.createDataFrame([("s1", "Retry policy", "# Retry\nThe retry_flag is set to 3000."), ("s2", "Other", "Nothing of note."), ("s3", None, None)], "id string, title string, content string"),
            spark.createDataFrame([("e1", "Kestrel", "about retries", ["retry_flag rules"])], "id string, name string, summary string, claims array<string>"),
            facts=True,
        ),
        spark.createDataFrame([("e1", "Kestrel")], "entity_id string, name string"),
        spark.createDataFrame([("e1", "s2")], "entity_id string, source_id string"),
    )
    q = spark.createDataFrame([("q1", "where is retry_flag in Kestrel"), ("q2", "")], "query_id string, query string")
    rows = engine.search(index, q, 3).orderBy("rank").collect()
    assert {r.doc_id for r in rows[:2]} == {"s1", "e1"} and {r.query_id for r in rows} == {"q1"}
    assert "s2" in {r.doc_id for r in rows}  # by way of the graph only
    shown = engine.show(engine.search(index, q, 3), index, q).where("rank = 1").first()
    assert "retry_flag" in shown.snippet


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "x", 1), (2, "y", 7)], "query_id int, doc_id string, rank int")
    gold = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "query_id int, doc_id string")
    m = evaluate.metrics(evaluate.hit_ranks(ranked, gold, gold)).first()
    assert (m.queries, m.recall_1, m.recall_10) == (3, 0.3333, 0.6667)
    assert m.mrr == round((1 + 1 / 7) / 3, 4) and m.ndcg_10 == round((1 + 1 / 3) / 3, 4)
    h = evaluate.haystacks(spark, 5, 4)
    assert h.count() == 20 and h.where("is_answer").count() == 5


def test_leader_clusters_equal_the_sequential_loop(spark):
    rng = random.Random(5)
    items = [(i, rng.choice("xy"), sorted(set(rng.choices("abcdefghij", k=rng.randint(0, 6)))), rng.randint(0, 20)) for i in range(120)]
    df = spark.createDataFrame(items, "id int, grp string, tokens array<string>, t int")
    for threshold in (0.3, 0.6):
        got = {r.id: r.leader for r in leader.cluster(df, threshold, [F.col("t")]).collect()}
        # few items in a block: several blocks, then pairs
        assert got == {r.id: r.leader for r in leader.cluster(df, threshold, [F.col("t")], block=3).collect()}
        want, leaders = {}, []
        for i, g, ts, t in sorted(items, key=lambda x: (x[3], x[0])):
            s = set(ts)
            found = next((j for j, h, u in leaders if h == g and s and u and len(s & u) / len(s | u) >= threshold - 1e-12), None)
            want[i] = i if found is None else found
            if found is None:
                leaders.append((i, g, s))
        assert got == want


def test_similar_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "id int, grp string, tokens array<string>")
    assert leader.similar_pairs(empty, 0.6).count() == 0
    assert leader.cluster(empty.withColumn("t", F.lit(1)), 0.6, [F.col("t")]).count() == 0
