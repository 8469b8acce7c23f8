"""Truncation, token ids, mixtures and residue."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recollect.llm import bpe, mixture, residue, truncation

# --- truncation -------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, kind, piece",
    [
        ("All is well.", "closed", ""), ("", "blank", ""), ("  \n", "blank", ""), ("It broke off in the mid", "open", "It broke off in the mid"), ("One. Two goes on and", "open", "Two goes on and"), ("bro�", "broken", ""), ("It went on…", "marked", "It went on"),
        ("It went on [truncated]", "marked", "It went on"), ("```\ncode", "fence", "code"), ("```\ncode\n```", "closed", ""), ("- item text", "open", "item text"), ("| a | b |", "closed", ""), ("完成了。下周需要", "open", "下周需要"), ("好。", "closed", ""), ("👍", "closed", ""), ("a=1; b=2;", "closed", ""),
    ],
)
def test_endings(text, kind, piece):
    assert truncation.ending(text)[:2] == (kind, piece)


def test_censored_fit_recovers_what_was_cut():
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(5.0, 0.8, 50_000))
    limit = 200
    cut = np.minimum(x, limit).astype(int)
    lengths, counts = np.unique(cut, return_counts=True)
    mu, sigma = truncation.log_normal_censored(lengths, counts, limit)
    assert abs(mu - 5.0) < 0.03 and abs(sigma - 0.8) < 0.03
    found = dict(truncation.censoring(lengths, counts))
    assert found[limit] > 0.98 and len(found) == 1
    free, n = np.unique(x.astype(int), return_counts=True)
    assert all(p < 0.9 for _, p in truncation.censoring(free, n))


def corpus(spark):
    rng = random.Random(2)
    nouns, verbs = ["parser", "writer", "linker", "reader", "walker"], ["lost its lock", "kept on retrying", "dropped the last page", "was rebuilt"]
    sentence = lambda: f"The {rng.choice(nouns)} {rng.choice(verbs)} after {rng.randint(1, 99)} runs of the nightly job."
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence() for _ in range(rng.randint(1, 6)))
        if i % 3 == 0 and len(text) > 150:
            text = text[:150]
            if not text.endswith("."):
                cut.add(str(i))
        elif i % 50 == 1:
            text = text[: rng.randint(20, len(text) - 14)]
            if not text.rstrip().endswith("."):
                cut.add(str(i))
        elif i % 10 == 2:
            text = text[:-1]  # lacks a full stop
        elif i % 10 == 3:
            text = rng.choice(["ok", "go on", "thanks", "hm, not sure…", "sounds good", "open a/b.py"])
        rows.append((i, "x" if i % 3 == 0 else "y", text))
    return rows, cut


def test_cut_records(spark):
    rows, cut = corpus(spark)
    ev = spark.createDataFrame([(i, a, f"src{i % 4}", t, 5) for i, a, t in rows] + [(9001, "x", None, None, 1), (9002, None, "s", "  ", 1), (None, "x", "s", "broken off in the", 1)], "id bigint, agent string, source_id string, content string, origin int")
    cl = spark.createDataFrame([("c1", "We saw that it bro�", [("s",)]), ("c1", "We saw that it bro�", [("s",)]), ("c2", None, None), ("c3", "", []), (None, "x", None)], "id string, text string, evidence array<struct<source_id:string>>")
    got = {(r.rel, r.row_key) for r in truncation.cut_records(ev, cl).collect()}
    mine = {k for rel, k in got if rel == "agent_events"}
    assert ("vault_claims", "c1") in got and not {"9001", "9002"} & mine
    assert len(mine & cut) >= 0.97 * len(cut) and len(mine - cut) <= 0.03 * len(cut)
    rates = {(r.rel, r.origin): r for r in truncation.rates(ev, cl).collect()}
    assert rates["agent_events", "x"].share > rates["agent_events", "y"].share > 0 and rates["vault_claims", "claims"].cut == 1


def test_no_texts(spark):
    ev = spark.createDataFrame([], "id bigint, agent string, source_id string, content string")
    cl = spark.createDataFrame([], "id string, text string, evidence array<struct<source_id:string>>")
    assert truncation.cut_records(ev, cl).count() == 0


# --- token ids --------------------------------------------------------------------------

ENCODER = bpe.Encoder()


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab a\n", max_size=80)), max_size=8))
def test_ids_equal_the_public_tokenizer(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}")
    t.encode_special_tokens = True
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    assert ENCODER(texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts(public):
    texts = ["a" * 30_000, "<|endoftext|> is text", "\r\n﻿ naïve é 👍​", "哈" * 500, " \n\n\t  ", "x" + " " * 1000 + "y", "\x00"]
    assert ENCODER(texts) == public(texts) and ENCODER([None, ""]) == [[], []]
    for text in texts:
        assert ENCODER([text]) == public([text])


def test_encode_corpus(spark, public):
    df = spark.createDataFrame([(1, "hello world", 9), (2, None, 9), (3, "", 9), (1, "hello world", 9), (None, "x", 9)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()), key=str)
    h = public(["hello world"])[0]
    assert got == sorted([(1, h), (1, h), (2, []), (3, []), (None, public(["x"])[0])], key=str)
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# --- mixtures ---------------------------------------------------------------------------


def documents(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 8 + ["small", "tiny", None, "other"]), "word " * rng.randint(0, 30)) for i in range(400)] + [(900, "big", None), (901, "big", ""), (1, "big", "word")]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, text string, n_tokens int")


def test_budgets_are_exact_and_repeats_bounded(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.2, 5), ("absent", 0.1, 3), (None, 0.5, 1), ("zero", None, None)], "source string, target_share double, max_repeats int")
    size = {}
    for r in bpe.count_tokens(docs.where("text is not null"), ["source", "doc_id"]).collect():
        size.setdefault(r.source, {})[r.doc_id] = max(r.n_tokens, size.get(r.source, {}).get(r.doc_id, 0))
    total = {s: sum(x.values()) for s, x in size.items()}
    whole = sum(total[s] for s in ("big", "small", "tiny"))
    for ranges, seed in ((1024, 7), (1, 7), (16, 8)):
        m = mixture.mix(docs, targets, seed=seed, ranges=ranges).collect()
        taken = {}
        for r in m:
            taken.setdefault(r.source, []).append(r)
        assert set(taken) == {"big", "small", "tiny"}
        for s, share, repeats in (("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.2, 5)):
            assert sum(r.taken for r in taken[s]) == min(round(share * whole), repeats * total[s])
            per = [(r.doc_id, r["pass"]) for r in taken[s]]
            assert len(per) == len(set(per)) and max(p for _, p in per) <= repeats
            assert sum(r.taken < r.n_tokens for r in taken[s]) <= 1
        first = sorted(taken["small"], key=lambda r: r.doc_id)
        full = [d for d in size["small"] if size["small"][d]]
        if max(r["pass"] for r in first) > 1:
            assert {r.doc_id for r in first if r["pass"] == 1} == set(full)
    rep = {r.source: r for r in mixture.shares(mixture.mix(docs, targets), targets).collect()}
    assert rep["absent"].tokens == 0 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-4 and rep["tiny"].most_repeats <= 5
    small = mixture.mix(docs, targets, total_tokens=100).collect()
    assert sum(r.taken for r in small) == 100


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert mixture.mix(documents(spark).limit(0), targets).count() == 0
    assert mixture.mix(documents(spark), targets.limit(0)).count() == 0


# --- residue ----------------------------------------------------------------------------

BAD = [
    "Dear ${USER_NAME},\n\nthank you.", "Summary: [INSERT DATE HERE]", "# Note\n\n502 Bad Gateway\nrelay/2.1", "Please enable JavaScript to view this vault.", "Ashgrove Wiki\nMenu  Search\nLoading… if nothing appears, allow scripts for this site.",
    "Lorem ipsum dolor sit amet", "Body copy goes here. Headline goes here.", '{"error": {"code": 429, "message": "quota exceeded"}}', "<html><head><title>x</title></head><body>Access denied.</body></html>", "owner: {{ owner }}\nfine text", "____________ (name)", "抱歉，您访问的页面不存在。",
    "【请在此填写摘要】", "系统繁忙，请稍后再试（错误码 500）", "asdf asdf jkl asdf",
]
GOOD = [
    None, "", "  \n", 'The importer saw "Please enable JavaScript" on 48 pages and now renders them first.', "Placeholder names like `__TOKEN__` are rejected by the lint step.", "```jinja\n{{ title }}\n```\nThe block above is how it is built.", "Error 404 made up 86% of the crawl, mostly links to deleted notes.",
    "We agreed not to ship lorem ipsum in the demo vault; every sample note was written by hand.", 'When a token expires the client sees "Your session has expired" and the hook logs it.', "## actions\n- The cache layer was rebuilt.", "The regex `\\$\\{[A-Z_]+\\}` finds open slots in a.yaml.", "抓取器有23次得到“页面不存在”的提示，我们把它记为失败。",
]


def bulk(n):
    rng = random.Random(4)
    return [f"The {rng.choice(['cache', 'graph', 'event'])} layer {rng.choice(['was rebuilt', 'kept retrying', 'lost its lock'])} after {rng.randint(1, 99)} runs." for _ in range(n)]


def test_residue(spark):
    rows = [(i, t) for i, t in enumerate([*BAD, *GOOD, *bulk(300)])] + [(0, BAD[0]), (None, BAD[1])]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id bigint, text string, score double")
    found = residue.residue(df).collect()
    ids = [r.doc_id for r in found]
    assert set(ids) == {*range(len(BAD)), None} and ids.count(0) == 2
    kept = residue.clean(df).collect()
    assert len(kept) == len(GOOD) + 300 + 1 and residue.residue(df.limit(0)).count() == 0


def test_words_of_trusted_passages_spread():
    noise = [residue.features(t) for t in bulk(400)]
    vocabulary = "dolor tarpis fringa molen ulvero vesti".split()
    rng = random.Random(5)
    filler = lambda: " ".join(rng.choices(vocabulary, k=12))
    seeds = [residue.features("lorem ipsum " + filler()) for _ in range(8)]
    hidden = [residue.features(filler()) for _ in range(8)]
    forms = noise + seeds + hidden
    model = residue.fit(forms, [1.0] * len(forms), [False] * 400 + [True] * 8 + [False] * 8)
    assert model.verdict(filler())[1] > residue.THRESHOLD and model.verdict(bulk(1)[0])[1] < 0
    assert residue.fit(noise, [1.0] * 400, [False] * 400).verdict(filler())[1] < 0


def test_held_out_accuracy_of_the_model_alone():
    """Forms whose trust is hidden from the fit are still scored as residue."""
    rng = random.Random(6)
    lines = ["Access denied. You lack permission to open this vault", "Too many requests. Slow down and retry in a moment", "Please enable JavaScript to view this vault", "This page is temporarily unavailable due to maintenance"]
    some = [f"{rng.choice(lines)} {rng.randint(1, 9)}" for _ in range(120)]
    content = bulk(600)
    forms = [residue.features(t) for t in [*content[:400], *some[:60]]]
    model = residue.fit(forms, [1.0] * len(forms), [False] * 400 + [i % 2 == 0 for i in range(60)])
    hit = sum(model.score(residue.features(t)) > residue.THRESHOLD for t in some[60:])
    false = sum(model.score(residue.features(t)) > residue.THRESHOLD for t in content[400:])
    assert hit >= 0.95 * 60 and false <= 2
