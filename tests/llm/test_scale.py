"""Verdicts rest on shares, not on how many texts there are."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import residue, truncation


def test_few_texts_can_show_a_limit():
    rng = random.Random(1)
    lengths = [rng.randint(20, 400) for _ in range(60)]
    free, n = np.unique(lengths, return_counts=True)
    assert not truncation.censoring(free, n)
    found = dict(truncation.censoring(*np.unique([x for x in lengths if x < 500] + [500] * 7, return_counts=True)))
    assert found.get(500, 0) > 0.9


def cut_keys(spark, texts):
    df = spark.createDataFrame([("e", str(i), "o", t) for i, t in enumerate(texts)], "rel string, key string, origin string, text string")
    return {int(r.key) for r in truncation.decide(df).where("score > 0").collect()}


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))


def test_three_pieces_of_many_are_no_repeating_line(spark):
    rng = random.Random(2)
    fill = lambda end: ("we moved " + words(rng, 15))[: 119 - len(end)] + " " + end
    pieces = [fill("cache of") for _ in range(3)] + [fill(words(rng, 2)) for _ in range(60)]
    other = [words(rng, rng.randint(3, 30)) + "." for _ in range(200)]
    assert {len(x) for x in pieces} == {120} and cut_keys(spark, pieces + other) == set(range(63))


def test_an_opening_closed_a_few_times_does_not_hide_a_cut(spark):
    rng = random.Random(3)
    pieces = ["they said " + words(rng, 5) + " the night"]
    closed = ["they said " + words(rng, 4) + "." for _ in range(10)] + [words(rng, rng.randint(3, 30)) + " the night." for _ in range(40)]
    assert 0 in cut_keys(spark, pieces + closed)


def test_lines_stay_lines(spark):
    rng = random.Random(4)
    assert cut_keys(spark, ["run the tests"] * 4 + [words(rng, 9) + "." for _ in range(50)]) == set()


def notes(rng, n):
    """Notes of which a tenth hold residue: (id, text)."""
    parts = ["the cache layer", "a graph merge", "one event queue", "our claim store"]
    lines = [f"{rng.choice(parts)} {rng.choice(['was rebuilt', 'kept retrying', 'lost its lock'])} after {i} runs." for i in range(n)]
    bad = ["Access denied.", "502 Bad Gateway", "Body copy goes here.", "Dear {{ name }},", "Please enable JavaScript to view this vault."]
    return [(i, f"{t}\n{rng.choice(bad)}" if i % 10 == 0 else f"{t}\nthe server said \"Access denied.\" twice") for i, t in enumerate(lines)]


@pytest.mark.parametrize("times", [10, 100])
def test_residue_grows_in_proportion_with_the_corpus(spark, times):
    df = spark.createDataFrame(notes(random.Random(5), 300), "doc_id bigint, text string")
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    once = {r.doc_id for r in residue.residue(df).collect()}
    assert once == set(range(0, 300, 10))
    found = residue.residue(many).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in found} == once and {r["count"] for r in found} == {times}


def test_a_sample_of_the_corpus_gives_the_same_residue(spark):
    df = spark.createDataFrame(notes(random.Random(6), 3000), "doc_id bigint, text string")
    whole = residue.residue(df, residue.learn(df)).select("doc_id").collect()
    part = residue.residue(df, residue.learn(df, sample=600)).select("doc_id").collect()
    assert set(whole) == set(part) == {(i,) for i in range(0, 3000, 10)}


def test_counts_a_hundred_times_as_large_change_no_verdict():
    texts = [t for _, t in notes(random.Random(7), 500)]
    counted = [(u, k) for t in texts for p in residue.passages(t) for u, k in residue.units(p)]
    forms, kinds = [u for u, _ in counted], [bool(k) for _, k in counted]
    verdicts = []
    for n in (1.0, 10.0, 100.0):
        model = residue.fit(forms, [n] * len(forms), kinds)
        verdicts.append([bool(residue.judge(t, model)) for t in texts])
    assert verdicts[0] == verdicts[1] == verdicts[2] and sum(verdicts[0]) == 50


def test_evidence_is_learned_from_the_limits():
    """Rows at limits tell how cut texts end; that decides on rows of other lengths."""
    own = [("r", None, "line", 500), ("r", None, "seen", 200), ("r", None, "open", 50)]
    at_words = [("r", 0.99, "open", 300), ("r", 0.99, "seen", 10)]
    at_seen = [("r", 0.99, "open", 10), ("r", 0.99, "seen", 300)]
    for limit, higher in ((at_words, "open"), (at_seen, "seen")):
        evidence, transfer = truncation.fit_endings(own + limit, 0.05)
        free, _ = truncation.fit_endings(own, 0.05)
        assert evidence["r", higher] > free["r", higher] and evidence["r", "line"] < 0
    evidence, transfer = truncation.fit_endings(own + at_words, 0.05)
    many, share = truncation.fit_endings([(r, p, k, 100 * n) for r, p, k, n in own + at_words], 0.05)
    assert abs(share["r"] - transfer["r"]) < 0.2 and all((many[x] + share["r"] > 0) == (evidence[x] + transfer["r"] > 0) for x in evidence if x[1] != "fence")
    assert truncation.fit_endings([], 1.0) == ({}, {})


def test_a_limit_may_be_short():
    rng = random.Random(8)
    lengths = [min(rng.randint(5, 80), 30) for _ in range(500)]
    assert dict(truncation.censoring(*np.unique(lengths, return_counts=True)))[30] > 0.9
