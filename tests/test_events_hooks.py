import json

from recollect.operators import events, hooks, umsf
from recollect.sources import pull

EV = "id bigint, source_id string, session_id string, agent string, ts double, type string, role string, name string, content string, args_json string, result string, error string, path string, metadata_json string"


def table(spark, *rows):
    base = dict(id=0, source_id="s", session_id="x", agent="a", ts=1.0, type="message", role="user", name="", content="", args_json="", result="", error="", path="", metadata_json="")
    return spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in EV.split(", ")) for r in rows], EV)


def test_filters_order_and_limit(spark):
    t = table(spark, dict(id=1, ts=3.0), dict(id=2, ts=1.0, args_json='{"a": 1}'), dict(id=3, type="error"), dict(id=4, ts=None), dict(id=5, session_id=None))
    assert [r.id for r in events.query_events(t, type="message", since=1.0, session_id="x").collect()] == [2, 1]
    assert [r.id for r in events.query_events(t, 1, True, type="message", session_id="x").collect()] == [1]
    assert events.query_events(t, type="none").count() == 0


def test_stats_and_distinct(spark):
    t = table(spark, dict(id=1), dict(id=9), dict(id=2, session_id="", type=None), dict(id=3, session_id=None, agent=None))
    got = {(r.dimension, r.value): r.n for r in events.stats(t).collect()}
    assert got["total", ""] == 4 and got["sessions", ""] == 1 and got["type", ""] == 1 and got["agent", ""] == 1
    assert sorted(r.id for r in events.distinct_events(t).collect()) == [1, 2, 3]


def test_documents_parse_validate_render(spark):
    good = {
        "schema": "ak/v1", "agent": "x", "source_type": "conversation", "session_id": "0123456789", "summary": "We chose parquet. Then more.", "unknown": 1,
        "events": [{"type": "decision", "content": "use parquet", "rationale": "small"}, None, {"type": "tool_use", "name": "bash", "args": {"a": "1", "b": [1], "c": "z" * 70, "d": "4"}}, {"type": "tool_result", "result": "l1\nl2"},
                   {"type": "file_change", "path": "a.py"}, {"type": "error", "error": "boom"}, {"type": "message", "role": "user", "content": " hi "}, {"type": "message", "content": ""}, {"type": "session_end"}],
    }
    rows = [good, {"source_type": "curated_memory", "title": "T", "context": json.dumps({"body": "## decisions\n- a decision"})}, {"source_type": "nope", "summary": "x"}, {"schema": "zz", "summary": "x"}, {"events": []}, {"summary": "x", "events": "text"},
            {"summary": "x", "actors": {"role": "user"}, "events": {"type": "message", "role": "a", "content": "lone"}}]
    raw = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(90, None), (91, "{"), (92, "[]"), (93, "")], "umsf_id bigint, payload string")
    parsed = umsf.parse(raw)
    verdict = {r.umsf_id: r.v for r in parsed.select("umsf_id", umsf.problem(parsed).alias("v")).collect()}
    assert verdict == {0: None, 1: None, 2: "unknown source type", 3: "unknown schema", 4: "nothing to ingest", 5: "events is no list", 6: None, 90: "not a document", 91: "not a document", 92: "not a document", 93: "not a document"}
    accepted, rejected = umsf.validate(parsed)
    assert accepted.count() == 3 and rejected.count() == 8
    md = {r.umsf_id: r.markdown for r in umsf.render(accepted).collect()}
    assert md[0] == (
        "# We chose parquet\n\n## summary\n\nWe chose parquet. Then more.\n\n## decisions\n\n- use parquet — rationale: small\n\n## actions\n\n- bash(a=1, b=…, c=" + "z" * 60 + "…, …)\n\n- result: l1 l2"
        "\n\n## actions\n\n- modified a.py\n\n## risks\n\n- boom\n\n## conversation\n\n**user**: hi"
    )
    assert md[1] == "# T\n\n## decisions\n- a decision"
    assert "**a**: lone" in md[6]
    assert events.append_rows(accepted.select(accepted.umsf_id.cast("string").alias("source_id"), "session_id", "agent", "events")).count() == 9


def test_hooks(spark):
    t = table(
        spark, dict(id=1, content="I prefer tabs and always will"), dict(id=2, content="plan to move next week", role=""), dict(id=3, role="assistant", content="Actually, I was wrong. Done."), dict(id=4, type="tool_use", name="bash", args_json='{"a": "1"}', result="token=abc path: /x"),
        dict(id=5, type="error", error="boom", name="bash", metadata_json='{"context": "ci"}'), dict(id=6, type="decision", content="we decided it"), dict(id=7, content="I l"), dict(id=8, content=None), dict(id=9, type="tool_use"),
        dict(id=10, type="session_end", metadata_json='{"messages": [{"role": "user", "text": "q"}, {"text": "a"}]}'), dict(id=11, type="error"),
    )
    got = {(r.event_id, r.hook): r for r in hooks.Registry().fire(t).collect()}
    assert set(got) == {(1, "message"), (2, "message"), (3, "response"), (4, "tool_use"), (5, "error"), (6, "decision"), (10, "session")}
    assert got[1, "message"].tags == ["preference", "directive"] and got[1, "message"].durability == "stable"
    assert got[2, "message"].durability == "temporary" and got[3, "response"].tags == ["correction", "commitment"]
    assert got[4, "tool_use"].text == "Tool: bash | Args: a=1 | Keys: abc, /x" and got[5, "error"].text == "Error: boom | Tool: bash | Context: ci"
    assert got[6, "decision"].confidence == 0.85 and got[10, "session"].text == "[user] q\n[unknown] a"
    assert {r.hook: r.fired for r in hooks.Registry().counts(t).collect()}["message"] == 2


def test_session_summaries(spark):
    t = table(spark, dict(id=1, content="a" * 300), dict(id=2, ts=0.5, role="", content="b"), dict(id=3, type="session_end"), dict(id=4, session_id="y", content="c"), dict(id=5, session_id="y", type="session_end"), dict(id=6, session_id="z", content="no end"))
    assert [tuple(r) for r in hooks.session_summaries(t).collect()] == [("x", 2, "[unknown] b\n[user] " + "a" * 200)]


def test_pull(spark):
    items = spark.createDataFrame([("m", "a", "1"), ("m", "b", "2"), ("m", "c", "3")], "adapter string, id string, fingerprint string")
    state = spark.createDataFrame([("m", "a", "1"), ("m", "b", "old"), ("other", "c", "3")], "adapter string, id string, fingerprint string")
    assert {r.id: r.state for r in pull.compare(items, state).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    due = pull.due(items, state)
    assert {r.id for r in due.collect()} == {"b", "c"} and pull.due(items, state, force=True).count() == 3
    after = pull.next_state(state, due.where("id = 'b'"))
    assert {(r.adapter, r.id, r.fingerprint) for r in after.collect()} == {("m", "a", "1"), ("m", "b", "2"), ("other", "c", "3")}
    r = pull.report(items, state, due.where("id = 'b'"), due.where("id = 'c'")).first()
    assert (r.discovered, r.ingested, r.errors, r.skipped) == (3, 1, 1, 1)
