"""Queries do the whole job: every row, whole texts, all signals."""

import re

from recollect.plans import corpus
from recollect.plans.corpus import AS_OF
from recollect.plans.registry import QUERIES


def texts(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("text is not null").select("doc_id", "text").collect()}


def test_rewrite_reads_every_whole_text(spark, data):
    want = texts(spark, data)
    assert any(len(t.split()) > 12 for t in want.values()) and any(i % 50 for i in want)
    got = {r.query_id: r.original for r in QUERIES["query_rewrite"](spark, data).collect()}
    assert {i: o.strip() for i, o in got.items()} == {i: t.strip() for i, t in want.items()}


def test_identifiers_behind_the_first_words(spark, tmp_path):
    long = "plain words " * 20 + "then max_retry_count fails"
    spark.createDataFrame([(1, long), (50, long), (2, None), (3, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.query_id: r for r in QUERIES["query_identifiers"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 50, 3} and got[3].exact == []
    assert all(got[i].exact == got[i].key_terms == ["max_retry_count"] and "fails" in got[i].terms for i in (1, 50))


def test_tokenize_keeps_every_token(spark, data):
    """Raw tokens, then pairs of CJK characters, then mixed neighbours, however many."""
    got = {r.doc_id: r for r in QUERIES["tokenize"](spark, data).collect()}
    assert any(r.n_tokens > 20 for r in got.values())
    for i, t in texts(spark, data).items():
        raw = re.findall(r"[一-鿿]|[a-zA-Z0-9_.-]+", t.lower())
        cjk = [x for x in raw if x >= "一"]
        mixed = [a + b for a, b in zip(raw, raw[1:]) if (a >= "一") != (b >= "一")]
        assert got[i].tokens == [*raw, *(a + b for a, b in zip(cjk, cjk[1:])), *mixed] and got[i].n_tokens == len(got[i].tokens)


def test_dream_scores_use_clusters_and_crossing(spark, data):
    """D3 to D5 claim by claim, as the cycle does it."""
    rows = {}
    for r in spark.read.parquet(f"{data}/vault_claims.parquet").where("id is not null").collect():
        rows.setdefault(r.id, r)
    c = sorted((r for r in rows.values() if r.status == "active" and r.text is not None), key=lambda r: (r.created_at, r.id))
    words = [set(re.findall(r"[一-鿿]|[a-zA-Z0-9_]+", r.text.lower())) for r in c]
    of = [-1] * len(c)
    for i in range(len(c)):
        if of[i] < 0:
            of[i] = i
            for j in range(i + 1, len(c)):
                if of[j] < 0 and words[i] and words[j] and len(words[i] & words[j]) / len(words[i] | words[j]) >= 0.3:
                    of[j] = i
    met = {}
    for r, k in zip(c, of):
        met.setdefault(r.entity_id, set()).add(k)
    want, crossed, grouped = {}, 0, 0
    for r, k in zip(c, of):
        evidence = [e for e in r.evidence or [] if e is not None]
        crosses = r.entity_id is not None and len(met[r.entity_id]) > 1
        crossed, grouped = crossed + crosses, grouped + (of.count(k) > 1)
        tags = r.tags or []
        parts = (
            0.24 * min(1, min(1, len(evidence) / 3) + min(0.3, (of.count(k) - 1) * 0.1)),
            0.30 * next((v for t, v in (("decision", 0.9), ("learning", 0.8), ("action", 0.6), ("todo", 0.3)) if t in tags), 0.4),
            0.15 * min(1, len({e.source_id for e in evidence}) / 2),
            0.15 * 2 ** (-((AS_OF - r.created_at) / 86400) / {"temporary": 3, "stable": 30}.get(r.durability, 7)),
            0.10 * (0.7 if r.entity_id is not None else 0.2),
            0.06 * min(1, min(1, len(r.text) / 100) + 0.3 * crosses),
        )
        want[r.id] = sum(parts)
    assert crossed and grouped
    got = {r.claim_id: r for r in QUERIES["dream_score"](spark, data).collect()}
    assert set(got) == set(want) and all(abs(got[i].score - s) < 2e-6 and got[i].promoted == (got[i].score >= 0.45) for i, s in want.items())
    report = QUERIES["dream_report"](spark, data).first()
    assert (report.candidates, report.promoted) == (len(want), sum(r.promoted for r in got.values())) and report.discarded == report.candidates - report.promoted


def test_sources_are_read_behind_the_stored_part(spark, data, tmp_path):
    x = spark.read.parquet(f"{data}/vault_sources.parquet")
    content = "filler line of words\n" * 600 + "\n## Decisions\n- We keep ticket ZQX-4711 open until May\n"
    row = {f.name: None for f in x.schema} | {"id": "s1", "title": "t", "content": content, "ingested_at": AS_OF - 60.0}
    spark.createDataFrame([tuple(row[f.name] for f in x.schema)], x.schema).write.parquet(f"{tmp_path}/vault_sources.parquet")
    d = str(tmp_path)
    for name in ("claim_extract", "dream_light"):
        assert any("ZQX-4711" in r.text for r in QUERIES[name](spark, d).collect()), name
    for name in ("entity_typed", "entity_extract"):
        assert "ZQX-4711" in {r.name for r in QUERIES[name](spark, d).collect()}, name
    assert corpus.sources(spark, d).first().content == content  # what the search index is made of
    assert QUERIES["source_load"](spark, d).first().stored_chars == 10_000
