import random
import re

from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.operators import claims as C
from recollect.operators import dream, entities, truth

MD = """# Head
Intro line that is long enough to count, and we decided to keep it. Short one. The cost rose by 5% this year!
## Decisions
- We adopted the new store
- short
A plain sentence without any of those marks here. Another plain sentence follows the first.
## Nowhere
- an item outside of known sections
Plain words of no importance stand here alone.
"""


def brute_claims(text):
    """A sequential version for comparison."""
    out, section, prose = [], "", []

    def flush():
        for s in re.split(r"(?<=[.!?。！？])\s+", " ".join(prose)):
            s = s.strip()
            if len(s) < 15:
                continue
            for p, w, t in ((L.DECISION, 1.0, "decision"), (L.FACT, 0.7, "fact"), (L.RISK, 0.7, "risk")):
                if re.search(p, s, re.I):
                    out.append((s[:500], w, t))
                    break
            else:
                w, t = L.SECTIONS.get(section, (0.4, None))
                if section in L.SECTIONS and w >= 0.7:
                    out.append((s[:500], w, t))
        prose.clear()

    for line in text.strip().split("\n"):
        line = line.strip()
        if line.startswith("##"):
            flush()
            section = line.lstrip("#").strip().lower()
        elif line and not line.startswith("#"):
            if line.startswith("- ") and len(line) > 10:
                w, t = L.SECTIONS.get(section, (0.4, None))
                out.append((line[2:].strip(), w, t))
            elif len(line) > 20:
                prose.append(line)
    flush()
    return out


def test_claims_equal_the_sequential_version(spark):
    rng = random.Random(1)
    lines = ["## decisions", "## 待办", "## other", "# top", "", "- an item of some length", "- tiny", "A sentence that goes on for a while. Then a risk appears! ok", "成本增长了很多，我们需要调整预算。 然后继续观察系统的状态。", "We migrated it"]
    texts = [MD, "", "   "] + ["\n".join(rng.choices(lines, k=rng.randint(1, 12))) for _ in range(40)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("null", None)], "id string, content string")
    got = {}
    for r in C.extract(df).orderBy("id", "ordinal").collect():
        got.setdefault(r.id, []).append((r.text, r.weight, r.tag))
    want = {str(i): brute_claims(t) for i, t in enumerate(texts) if brute_claims(t)}
    assert got == want and len(got) > 20


def test_foresight_and_expiry(spark):
    df = spark.createDataFrame([("c1", "We will ship next week"), ("c2", "It was shipped")], "claim_id string, text string")
    f = C.foresight(df, 1000.0)
    assert [(r.claim_id, r.valid_until, r.status) for r in f.collect()] == [("c1", 1000.0 + 7 * 86400, "pending")]
    assert dream.expire(f, 1000.0 + 8 * 86400).first().status == "expired" and dream.expire(f, 1000.0).first().status == "pending"


CLAIM = "claim_id string, entity_id string, text string, tags array<string>, status string, polarity string, durability string, confidence double, created_at double, evidence array<struct<source_id:string,weight:double>>"


def claims(spark, *rows):
    base = dict(entity_id="e", text="", tags=[], status="active", polarity="neutral", durability="unknown", confidence=0.6, created_at=0.0, evidence=[])
    return spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in re.split(r", (?=\w+ )", CLAIM)) for r in rows], CLAIM)


def test_merge_evidence(spark):
    df = claims(
        spark, dict(claim_id="a", text=" Same ", evidence=[("s1", 1.0), ("s1", 0.4)]), dict(claim_id="b", text="same", created_at=1.0, evidence=[("s2", 0.7)]), dict(claim_id="c", text="other", evidence=None), dict(claim_id="d", text=None),
    )
    got = {r.key: (r.claim_id, r.sources, r.weight, r.confidence) for r in truth.merge_evidence(df).collect()}
    assert got == {"same": ("a", 2, 1.7, round(1.7 / 2.7, 3)), "other": ("c", 0, 0.0, 0.0)}


def test_summary(spark):
    df = claims(
        spark, *(dict(claim_id=f"d{i}", text=f"decision {i}", tags=["decision"], confidence=0.5 + i / 10) for i in range(5)), dict(claim_id="o", text="untagged"), dict(claim_id="x", text="gone", status="superseded"),
        dict(claim_id="s", entity_id="only", text="t" * 300, tags=["summary"]),
    )
    got = {r.entity_id: r.summary for r in truth.summaries(df).collect()}
    assert got == {"e": "[决策] decision 4; decision 3; decision 2 | [其他] untagged", "only": "t" * 200}


def test_supersede_both_phases(spark):
    df = claims(
        spark, dict(claim_id="new", text="a b c d e", created_at=2.0), dict(claim_id="old", text="a b c d f", created_at=1.0), dict(claim_id="t1", text="p q r s", created_at=3.0, durability="temporary"),
        dict(claim_id="t2", text="p q r z y", created_at=1.0), dict(claim_id="u", text="p q r", entity_id="other"), dict(claim_id="far", text="x y z", created_at=0.5),
    )
    got = {r.claim_id: r.status for r in truth.supersede(df).collect()}
    assert got == {"new": "active", "old": "superseded", "t1": "active", "t2": "superseded", "u": "active", "far": "active"}


def test_consolidate_newest_first(spark):
    df = spark.createDataFrame([("1", "g", "a b c d", 1.0), ("2", "g", "a b c d e", 2.0), ("3", "h", "a b c d", 3.0), ("4", "g", None, 9.0), ("5", "g", "a b c d", 1.0)], "id string, grp string, text string, timestamp double")
    got = {r.id: (r.leader, r.weight) for r in truth.consolidate(df).collect()}
    assert got == {"1": ("2", 0.3), "2": ("2", 1.0), "3": ("3", 1.0), "4": ("4", 1.0), "5": ("2", 0.3)}


def test_contradictions_need_confidence_on_both_sides(spark):
    df = claims(
        spark, dict(claim_id="p", text="we enable it"), dict(claim_id="n", text="x", polarity="negative"), dict(claim_id="n2", text="disable it"), dict(claim_id="w", text="disable it", confidence=0.5), dict(claim_id="q", entity_id="o", text="enable"),
    )
    assert [tuple(r) for r in truth.contradictions(df).collect()] == [("e", 1, 2, 2)]
    assert {(r.claim_a, r.claim_b) for r in truth.contradicting_pairs(df).collect()} == {("n", "p"), ("n2", "p")}


def test_dream_score_by_hand(spark):
    row = dict(claim_id="c", text="x" * 50, tags=["todo"], durability="temporary", created_at=0.0, entity_id="e", crosses=True, evidence_count=2, source_count=1, cluster_size=3)
    df = spark.createDataFrame([row], "claim_id string, text string, tags array<string>, durability string, created_at double, entity_id string, crosses boolean, evidence_count int, source_count int, cluster_size int")
    r = dream.score(df, 3 * 86400.0).first()
    want = 0.24 * min(1, 2 / 3 + 0.2) + 0.30 * 0.3 + 0.15 * 0.5 + 0.15 * 0.5 + 0.10 * 0.7 + 0.06 * 0.8
    assert abs(r.score - want) < 1e-6 and r.promoted == (want >= 0.45)
    assert dream.score(df, 3 * 86400.0, linked=False).first().score < r.score


def test_entities(spark):
    text = "Mail a.b@kiln.example or see https://x.test/a, JIRA-12 on 2026-05-16 at 10:30; paid $1,200 and 74.5% for v2.3. The Northern Hemisphere uses MySQL and retry_flag. 2026年5月16日 2026年5月"
    df = spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "id string, content string")
    got = {r.name: r.type for r in entities.extract(df).collect()}
    assert got["a.b@kiln.example"] == "identifier" and got["JIRA-12"] == "identifier" and got["2026-05-16"] == "time" and got["$1,200"] == "money" and got["74.5%"] == "quantity" and got["v2.3"] == "version"
    assert got["2026年5月16日"] == "time" and "2026年5月" not in got
    assert got["Northern Hemisphere"] == "named" and "MySQL" in got and "retry_flag" in got
    more = {r.name: r.type for r in entities.extract(df, extra_patterns={"unit": [r"(hemi\w+)"]}, extra_names=["uses MySQL"]).collect()}
    assert more["Hemisphere"] == "unit" and more["uses MySQL"] == "named"


def test_cjk_chunks_equal_the_sequential_version(spark):
    words, particles = L.name_stop_cn(), L.PARTICLES
    rng = random.Random(6)
    parts = [*rng.sample(sorted(words), 25), *"的了在", "凭证", "成本中心", "银行", "高优先级规则", "a", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(150)]

    def brute(text):
        out = set()
        for run in re.findall("[一-鿿]+", text):
            chunks, current, i = [], "", 0
            while i < len(run):
                n = next((k for k in range(min(4, len(run) - i), 1, -1) if run[i : i + k] in words), 0) or (1 if run[i] in particles else 0)
                if n:
                    chunks.append(current)
                    current, i = "", i + n
                else:
                    current, i = current + run[i], i + 1
            for c in [*chunks, current]:
                if 2 <= len(c) <= 4 or len(c) > 4 and any(re.search(p, c) for _, p in L.SUFFIXES):
                    out.add(c)
                elif len(c) > 4:
                    out |= {c[:4], c[-4:]}
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: set(r.v) for r in df.select("i", entities.cjk_chunks(F.col("t")).alias("v")).collect()}
    assert all(got[i] == brute(t) for i, t in enumerate(texts))


def test_non_entities(spark):
    names = ["a", "12.5", "1,000", "The", "我们", "我们这个", "是成本", "成本中心", "Kestrel", "the"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.v for r in df.select(entities.is_non_entity(F.col("n")).alias("v")).collect()]
    assert got == [True, True, True, True, True, True, True, False, False, False]


def test_resolve_and_link(spark):
    known = spark.createDataFrame([("e1", "Kestrel", ["The Hawk"]), ("e2", "kestrel", None)], "id string, name string, aliases array<string>")
    found = spark.createDataFrame([("KESTREL",), ("the hawk",), ("Thistle",)], "name string")
    got = {r.name: (r.entity_id, r.is_new) for r in entities.resolve(found, known).collect()}
    assert got["KESTREL"] == ("e1", False) and got["the hawk"] == ("e1", False) and got["Thistle"][1]
    c = spark.createDataFrame([("s", "c1", "Thistle uses Kestrel"), ("s", "c2", "none"), ("t", "c3", "Kestrel")], "source_id string, claim_id string, text string")
    n = spark.createDataFrame([("s", "e1", "kestrel"), ("s", "e3", "thistle"), ("s", "e4", "thistle uses")], "source_id string, entity_id string, name string")
    assert {r.claim_id: r.entity_id for r in entities.link(c, n, ["source_id"]).collect()} == {"c1": "e4"}


def test_timeline_has_rows_without_claims(spark):
    m = spark.createDataFrame([("s", "e"), ("s", "f")], "source_id string, entity_id string")
    c = spark.createDataFrame([("s", "e"), ("s", "e")], "source_id string, entity_id string")
    s = spark.createDataFrame([("s", "T")], "id string, title string")
    got = {r.entity_id: (r.date, r.title, r.body) for r in truth.timeline(m, c, s, 0.0).collect()}
    assert got == {"e": ("1970-01-01", "New evidence from: T", "Extracted 2 claims"), "f": ("1970-01-01", "New evidence from: T", "Extracted 0 claims")}


def test_dream_clusters_and_crossing(spark):
    df = spark.createDataFrame([("a", "x y z", 1.0), ("b", "x y w", 2.0), ("c", "q r", 3.0)], "claim_id string, text string, t double")
    got = {r.claim_id: (r.leader, r.size) for r in dream.clusters(df, [F.col("t")]).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1)}
    linked = spark.createDataFrame([("a", "e"), ("c", "e"), ("b", "f")], "claim_id string, entity_id string")
    assert [r.entity_id for r in dream.across(dream.clusters(df, [F.col("t")]), linked).collect()] == ["e"]
