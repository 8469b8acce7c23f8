"""Consensus, ranking and conversations: small cases and brute force."""

import datetime as dt
import itertools
import random

from recollect.llm import consensus, conversations, ranking

# --- consensus --------------------------------------------------------------------------

FACT = "fact_id bigint, fact string, entities array<string>, timestamp double, source string, supersedes string, weight double, claim_id string, group string"


def facts(spark, *rows):
    base = dict(fact="", entities=["e"], timestamp=1.0, source="s", supersedes="p", weight=0.5, claim_id="c", group="clash")
    return spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in FACT.split(", ")) for r in rows], FACT)


def claims(spark, *rows):
    return spark.createDataFrame(list(rows) or [("c", 0.5), ("c", 0.4), (None, 1.0), ("high", 0.9), ("nan", float("nan"))], "id string, confidence double")


def test_survivor_is_the_best_in_every_field(spark):
    df = facts(
        spark, dict(fact_id=1, fact="The cat  sat."), dict(fact_id=2, fact="> **the CAT** sat!", timestamp=2.0, claim_id="high"), dict(fact_id=3, fact="the cat sat", entities=[], timestamp=2.0, claim_id="high"), dict(fact_id=4, fact="the cat sat down"),
        dict(fact_id=5, fact=None), dict(fact_id=6, fact=""), dict(fact_id=7, fact="  !! "), dict(fact_id=None, fact="the cat sat", timestamp=9.0), dict(fact_id=8, fact="ｔｈｅ ｃａｔ\nsat", timestamp=None, weight=float("nan"), claim_id=None), dict(fact_id=2, fact="> **the CAT** sat!", timestamp=2.0, claim_id="high"),
    )
    rows = consensus.survivors(df, claims(spark)).collect()
    assert [(r.fact_id, r.missed, r.records) for r in rows] == [(2, 0, 4)]
    assert consensus.survivors(df.limit(0), claims(spark)).count() == 0


def test_ties_and_repeats(spark):
    df = facts(spark, dict(fact_id=9, fact="a b"), dict(fact_id=3, fact="a b"), dict(fact_id=3, fact="a b"), dict(fact_id=5, fact="c"), dict(fact_id=5, fact="c"))
    assert [r.fact_id for r in consensus.survivors(df, claims(spark)).collect()] == [3]


def test_parts_change_nothing(spark):
    rng = random.Random(1)
    rows = [dict(fact_id=i, fact=rng.choice(["Alpha beta, gamma", "alpha BETA gamma!", "* alpha beta gamma", "delta"]), timestamp=rng.choice([1.0, 2.0]), weight=rng.choice([0.1, 0.7])) for i in range(60)]
    one = {(r.fact_id, r.consensus) for r in consensus.survivors(facts(spark, *rows), claims(spark)).collect()}
    many = {(r.fact_id, r.consensus) for r in consensus.survivors(facts(spark, *rows), claims(spark), part=1).collect()}
    assert one == many and len(one) == 2


def test_alignment_puts_words_under_words():
    rows = [("the old cat sat".split(), 1.0), ("the cat sat".split(), 2.0), ("a cat sat down".split(), 1.0)]
    profile, weight = consensus._fold((consensus.as_profile(w, w, x), x) for w, x in rows)
    assert weight == 4.0 and consensus.vote(profile) == ["the", "cat", "sat"]
    assert consensus.align([], consensus.as_profile(["x"], ["x"], 1.0), 2.0, 1.0) == [{"": {"": 2.0}, "x": {"x": 1.0}}]


def test_consensus_of_records_that_differ_in_words(spark):
    df = facts(
        spark, dict(fact_id=1, fact="Adopted KV-11434474 for the old cache, 504 rows.", weight=1.0), dict(fact_id=2, fact="We adopted kv-11434474 for the cache, 504 rows!", weight=0.9), dict(fact_id=3, fact="adopted KV-11434474 for the cache, 505 rows", weight=0.8),
        dict(fact_id=4, fact="adopted KV-1 for x"), dict(fact_id=5, fact="adopted KV-1 for x"), dict(fact_id=6, fact=None), dict(fact_id=7, fact="KV-11434475 alone"),
    )
    for part in (consensus.PART, 1):
        (row,) = consensus.consensus(df, claims(spark), part=part).collect()
        assert (row.texts, row.records, row.consensus) == (3, 3, "Adopted KV-11434474 for the cache, 504 rows") and row.fact_id in (1, 3)
    assert consensus.consensus(df.limit(0), claims(spark)).count() == 0


def test_table_groups_with_insertions_are_aligned(spark, data):
    read = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    rows = consensus.consensus(read("consolidated_facts"), read("vault_claims")).where("texts > 1").collect()
    assert rows and all(r.records >= r.texts > 1 and r.consensus for r in rows)


# --- ranking ----------------------------------------------------------------------------

NAN = float("nan")


def test_no_list_drowns_the_others(spark):
    res = [(1, "bm25", f"p{i}", 1000.0 * i) for i in range(9)] + [(1, "vector", f"p{i}", 0.5 + i / 1000) for i in range(9)] + [(1, "exact", "p0", 1e12), (1, "exact", "p8", 5.0), (1, "exact", "p3", 4.0), (1, "exact", "p4", 4.5), (1, "exact", "p5", 4.2)]
    res += [(1, "bm25", "p8", 8000.0), (1, "bm25", "px", NAN), (1, "bm25", "py", None), (2, "bm25", "only", NAN), (3, "bm25", "b", 1.0), (3, "bm25", "a", 1.0), (None, "bm25", "z", 1.0), (4, "bm25", "inf", float("inf")), (4, "bm25", "neg", float("-inf")), (4, "bm25", "mid", 0.0)]
    results = spark.createDataFrame([(*r, 7) for r in res], "query_id bigint, list_name string, id string, score double, value int")
    dream = spark.createDataFrame([("p8", 0.9), ("p8", NAN), ("p0", 0.1), ("p3", None), (None, 5.0), ("unseen", 9.0)], "source_id string, score double")
    fused = ranking.fuse(ranking.all_scores(results, dream))
    assert {r.query_id: r.id for r in ranking.best_pages(fused).collect()} == {1: "p8", 2: "only", 3: "a", 4: "inf"}
    assert all(0 <= r.value < 1 for r in fused.collect())
    for slices in (1, 64):
        got = {}
        for r in ranking.ranks(fused, slices).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.id
        assert [got[4][k] for k in sorted(got[4])] == ["inf", "mid", "neg"] and sorted(got[1]) == list(range(1, 12)) and got[1][1] == "p8" and {got[1][10], got[1][11]} == {"px", "py"}
    only_exact = ranking.fuse(ranking.all_scores(results, dream), {"bm25": 0, "vector": 0, "dream": 0})
    assert {r.query_id: r.id for r in ranking.best_pages(only_exact).collect()} == {1: "p0"}


def test_nothing_to_rank(spark):
    results = spark.createDataFrame([], "query_id bigint, list_name string, id string, score double")
    dream = spark.createDataFrame([], "source_id string, score double")
    fused = ranking.fuse(ranking.all_scores(results, dream))
    assert fused.count() == 0 and ranking.best_pages(fused).count() == 0 and ranking.ranks(fused).count() == 0


def test_missing_scores_leave_their_list_as_it_is(spark):
    """A null or NaN score is no low score: medians and floors are those of the present ones."""
    rows = [(1, "bm25", f"p{i}", float(i)) for i in range(7)] + [(1, "vector", f"p{i}", 1.0 - i / 10) for i in range(7)]
    more = rows + [(1, "vector", f"q{i}", x) for i, x in enumerate([None, NAN, None, None])] + [(1, "bm25", f"q{i}", -5.0) for i in range(4)]
    base = rows + [(1, "bm25", f"q{i}", -5.0) for i in range(4)]
    schema = "query_id bigint, list_name string, id string, score double"
    value = lambda x: {r.id: r.value for r in ranking.fuse(spark.createDataFrame(x, schema)).collect()}
    assert value(more) == value(base)


# --- conversations ----------------------------------------------------------------------

EV = "id bigint, session_id string, ts double, type string, role string, content string, loaded_at timestamp, t int"
T0 = dt.datetime(2025, 1, 1)


def events(spark, rows):
    full = [(r[0], r[1], r[2], r[3] if len(r) > 5 else "message", *r[-2:], T0 + dt.timedelta(seconds=float(r[2] or 0)), 1) for r in rows]
    return spark.createDataFrame(full, EV)


def brute(rows):
    sessions = {}
    for id_, s, ts, *kind, role, content in rows:
        if s:
            m = sessions.setdefault(s, {})
            if (not kind or kind[0] == "message") and content and content.strip():
                k = (ts, role, content)
                m[k] = min(m.get(k, id_), id_)
    drop = set()
    for s, m in sessions.items():
        who = []
        for (ts, role, _), _id in sorted(m.items(), key=lambda x: (-1 if x[0][0] is None else x[0][0], x[1])):
            r = (role or "").strip().lower()
            who.append("none" if not r else "u" if r in ("user", "human") else "a" if r in ("assistant", "ai", "model") else "")
        talk = [w for w in who if w in ("u", "a")]
        if "none" in who or "u" not in talk or "a" not in talk or talk[0] == "a" or any(x == "u" and y != "a" for x, y in itertools.zip_longest(talk, talk[1:])):
            drop.add(s)
    return set(sessions), drop


def test_judge_equals_brute_force_for_every_stretch(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        role = rng.choice(["user", "Human", "ASSISTANT", "ai", "model", "model", "system", "tool"] * 4 + [None, " ", "odd"])
        session = rng.choice([*"abcdefghijklmnopqrstuvwxyz", None, "", " ", f"s{i}"])
        ts = None if rng.random() < 0.01 else float(rng.randint(0, 40))
        rows.append((i, session, ts, rng.choice(["message"] * 8 + ["tool_use"]), role, rng.choice(["x", "y", "z", "　", "", None])))
    rows += [(2000 + k, f"good{k}", float(t), "message", r, f"{t}") for k in range(5) for t, r in enumerate(["user", "assistant", "assistant", "user", "system", "ai"])]
    every, drop = brute(rows)
    df = events(spark, rows)
    for stretch in (3600.0, 7.0, 1.0):
        j = conversations.judge(df, stretch).collect()
        assert {r.session_id for r in j} == every and {r.session_id for r in j if r.broken} == drop
        turns = conversations.turns(df, stretch).collect()
        assert {r.session_id for r in turns} == every - drop
        for s in {r.session_id for r in turns}:
            mine = sorted((r.turn, r.ts) for r in turns if r.session_id == s)
            assert [t for t, _ in mine] == list(range(1, len(mine) + 1)) and [x for _, x in mine] == sorted(x for _, x in mine)
    assert len(every - drop) >= 5


def test_milliseconds(spark):
    rows = [(1, "s", 1737518567556.0, "message", "user", "q"), (2, "s", 1737518568.0, "message", "ai", "a")]
    df = spark.createDataFrame([(*r, T0, 1) for r in rows], EV)
    assert not conversations.judge(df).first().broken
    assert [r.ts for r in conversations.turns(df).orderBy("turn").collect()] == [1737518567.556, 1737518568.0]


def at(spark, *rows):
    """Rows of (hour of arrival, session, ts)."""
    return spark.createDataFrame([(i, s, float(t), "message", "user", f"m{t}", T0 + dt.timedelta(hours=h), 1) for i, (h, s, t) in enumerate(rows)], EV)


def test_overlapping_exports_are_merged(spark):
    chain = [(0, "chain", t) for t in (1, 2, 3)] + [(1, "chain", t) for t in (2, 3, 4, 5)] + [(2, "chain", t) for t in (5, 6)] + [(3, "chain", 4)]
    gap = [(0, "gap", 1), (1, "gap", 3)]
    fork = [(0, "fork", t) for t in (1, 2)] + [(1, "fork", t) for t in (2, 3)] + [(2, "fork", t) for t in (2, 4)]
    twice = [(0, "twice", 1), (0, "twice", 2), (5, "twice", 1), (5, "twice", 2)]
    got = {r.session_id: (r.fragments, r.contained, r.merged, r.gaps, r.kept) for r in conversations.assemble(at(spark, *chain, *gap, *fork, *twice)).collect()}
    assert got == {"chain": (4, 1, 2, 0, True), "gap": (2, 0, 0, 1, False), "fork": (3, 0, 0, 2, False), "twice": (2, 1, 0, 0, True)}


def test_merged_conversations_hold_each_message_once_in_order(spark):
    chain = [(2, "chain", t) for t in (1, 2, 3)] + [(1, "chain", t) for t in (2, 3, 4, 5)] + [(0, "chain", t) for t in (5, 6)] + [(3, "chain", 4)]
    gap = [(0, "gap", 1), (1, "gap", 3)]
    whole = [(0, "whole", t) for t in range(1, 8)]
    got = {}
    for r in conversations.merged(at(spark, *chain, *gap, *whole)).collect():
        got.setdefault(r.session_id, []).append((r.turn, r.ts))
    assert {s: sorted(x) for s, x in got.items()} == {"chain": [(t, t) for t in range(1, 7)], "whole": [(t, t) for t in range(1, 8)]}


def test_no_events(spark):
    df = spark.createDataFrame([], EV)
    assert conversations.judge(df).count() == 0 and conversations.turns(df).count() == 0 and conversations.assemble(df).count() == 0 and conversations.merged(df).count() == 0
