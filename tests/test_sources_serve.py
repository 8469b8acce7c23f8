import io
import json


from recollect.plans import ingest
from recollect.serve import cli, rpc
from recollect.sources import embedder, files, glossary
from recollect.sources.vault import Vault
from recollect.streaming import capture
from recollect.streaming.watch import WatchedFiles


def test_vault_versions(spark, tmp_path):
    v = Vault(spark, str(tmp_path / "v"))
    assert not v.is_initialized
    v.init().init()
    assert v.is_initialized and v.stats()["sources"] == 0
    row = lambda t: spark.createDataFrame([("s1", t, "x" * 20_000, "text", 1)], "id string, title string, content string, source_type string, clash int")
    v.save("sources", row("one"))
    v.save("sources", row("two"))
    r = v.load("sources").first()
    assert v.load("sources").count() == 1 and r.title == "two" and len(r.content) == 10_000
    assert v.get("sources", "s1").first().title == "two" and v.get("sources", "none").count() == 0
    v.compact("sources")
    assert v.versions("sources").count() == 1 and v.load("sources").first().title == "two"
    v.delete("sources", v.load("sources"))
    assert v.load("sources").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xef\xbb\xbf# Alpha")
    (tmp_path / "b.md").write_bytes(b"caf\xe9")
    (tmp_path / "c.txt").write_text("no")
    got = {r.title: r.content for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got["a"] == "# Alpha" and got["b"].startswith("caf") and set(got) == {"a", "b"}
    root = tmp_path / "hermes"
    root.mkdir()
    (root / "MEMORY.md").write_text("remember")
    (root / "USER.md").write_text("  ")
    (root / "OTHER.md").write_text("no")
    m = files.markdown_memories(spark, {"hermes": str(root), "unknown": str(root)}, [str(tmp_path / "a.md")]).collect()
    assert {(r.agent, r.role, r.title) for r in m} == {("hermes", "memory", "[hermes] MEMORY.md"), ("custom", "memory", "[custom] a.md")}


def test_transcripts(spark, tmp_path):
    rows = [
        {"type": "user", "timestamp": "2026-05-14T08:21:08.323Z", "sessionId": "s", "message": {"content": "  first question " + "x" * 100}}, {"type": "summary", "message": {"content": "skip"}}, {"type": "user", "message": {"content": "  "}},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "y" * 2000}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "t1", "name": "bash", "input": {"a": 1}}, {"type": "odd"}, "str"]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "l1"}, "l2"], "is_error": True}, {"type": "tool_result", "content": "ok"}]}},
    ]
    folder = tmp_path / "projects" / "demo"
    folder.mkdir(parents=True)
    (folder / "u.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n\n[1]\n")
    e = files.read_transcripts(spark, str(tmp_path / "projects"), project="dem").orderBy("line", "block").collect()
    assert [(r.type, r.role) for r in e] == [("message", "user"), ("message", "assistant"), ("tool_use", ""), ("message", "assistant"), ("tool_result", ""), ("tool_result", "")]
    assert len(e[1].content) == 1500 and e[1].content.endswith("…") and e[0].ts == 1778746868.323 and e[0].session_id == "s"
    assert e[2].name == "bash" and json.loads(e[2].args) == {"a": 1} and json.loads(e[3].metadata) == {"unknown_block_type": "odd"}
    assert (e[4].error, e[4].result, e[5].result) == ("l1\nl2", "", "ok")
    assert files.read_transcripts(spark, str(tmp_path / "projects"), project="other").count() == 0
    assert files.read_transcripts(spark, str(tmp_path / "projects"), thinking=True, limit=1).count() == 7
    assert files.transcript_titles(files.read_transcripts(spark, str(tmp_path / "projects"))).first().title == ("first question " + "x" * 100)[:80] + "…"


def test_glossary(tmp_path):
    text = "entities:\n  - Kestrel\n  - 'It''s'\npatterns:\n  unit:\n    - \"(\\\\d+)px\"\n    - '(bad'\n# note\n"
    assert glossary.parse(text) == ({"unit": ["(\\d+)px"]}, ["Kestrel", "It's"])
    assert glossary.load(str(tmp_path / "none")) == ({}, [])


def test_embedder_gives_zeros_where_it_fails(spark):
    def make():
        def f(texts):
            if "bad" in texts:
                raise ValueError
            return [[float(len(t)), 1.0] for t in texts]

        return f

    d = spark.createDataFrame([("a", "xx"), ("b", None)], "doc_id string, text string").coalesce(1)
    assert {r.doc_id: r.vector for r in embedder.embed(d, make, 2).collect()} == {"a": [2.0, 1.0], "b": [0.0, 1.0]}
    assert embedder.embed(spark.createDataFrame([("a", "bad")], "doc_id string, text string"), make, 2).first().vector == [0.0, 0.0]


def test_rpc_and_ingest(spark, tmp_path):
    root = str(tmp_path / "v")
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / ".entities.yaml").write_text("entities:\n  - warm cache\n")
    lines = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "ak_ingest", "arguments": {"text": "## decisions\n- Kestrel adopted the warm cache for retry_flag\n- plan to enable retry_flag next week", "title": "First"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "ak_query", "arguments": {"query": "retry_flag"}}}, {"id": 5, "method": "tools/call", "params": {"name": "nope"}}, {"id": 6, "method": "nope"}, {"id": 7, "method": "tools/call", "params": {"name": "ak_stats"}},
        {"id": 8, "method": "resources/read", "params": {"uri": "ak://entities"}}, {"id": 9, "method": "prompts/get", "params": {"name": "knowledge_summary", "arguments": {"entity_name": "WARM CACHE"}}}, {"id": 10, "method": "prompts/get", "params": {"name": "contradiction_check"}},
        {"id": 11, "method": "tools/call", "params": {"name": "ak_hook_fire", "arguments": {"type": "message", "role": "user", "content": "I prefer parquet"}}}, {"id": 12, "method": "tools/call", "params": {"name": "ak_hook_stats"}}, {"id": 13, "method": "tools/call", "params": {"name": "ak_dream"}},
        {"id": 14, "method": "resources/list"}, {"id": 15, "method": "tools/call", "params": {"name": "ak_query", "arguments": {}}}, {"id": 16, "method": "tools/call", "params": {"name": "ak_ingest_umsf", "arguments": {"doc": {"source_type": "nope"}}}},
    ]
    out = io.StringIO()
    rpc.run(spark, root, ["broken{", "", *(json.dumps(m) for m in lines)], out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert replies[0]["error"]["code"] == -32700
    by = {r["id"]: r for r in replies}
    said = lambda i: by[i]["result"]["content"][0]["text"]
    assert len(by[2]["result"]["tools"]) == 8 and "Claims: 2" in said(3) and "First" in said(4)
    assert by[5]["error"]["code"] == -32602 and by[6]["error"]["code"] == -32601
    assert "sources: 1" in said(7) and "claims: 2" in said(7)
    assert "warm cache" in by[8]["result"]["contents"][0]["text"]
    assert "Kestrel adopted the warm cache" in by[9]["result"]["messages"][0]["content"]["text"] or "warm cache" in by[9]["result"]["messages"][0]["content"]["text"]
    assert "No contradictions" in by[10]["result"]["messages"][0]["content"]["text"]
    assert "Hooks matched: 1" in said(11) and said(12) == "message: 1" and "candidates" in said(13)
    assert any(r["uri"].startswith("ak://sources/") for r in by[14]["result"]["resources"])
    assert by[15]["result"]["isError"] and by[16]["result"]["isError"]


def test_ingest_again_changes_nothing(spark, tmp_path):
    v = Vault(spark, str(tmp_path / "v")).init()
    docs = spark.createDataFrame([("We adopted the new store for all of it.",), (None,), ("  ",)], "content string")
    for _ in range(2):
        ingest.texts(v, docs, as_of=1000.0)
    s = v.stats()
    assert (s["sources"], s["claims"]) == (1, 1)


def test_cli(tmp_path):
    root, out = str(tmp_path / "v"), io.StringIO()
    assert cli.main(["stats", root], out) == 1
    assert cli.main(["init", root], out) == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("## risks\n- the retry_flag may fail again\n")
    assert cli.main(["batch-ingest", root, str(tmp_path / "in")], out) == 0
    assert cli.main(["query", root, "retry_flag"], out) == 0
    mem = tmp_path / "codex"
    mem.mkdir()
    (mem / "AGENTS.md").write_text("## decisions\n- always use the cold path\n")
    pull = ["pull", root, "--root", f"codex={mem}"]
    assert cli.main([*pull, "--dry-run"], out) == cli.main(pull, out) == cli.main(pull, out) == 0
    text = out.getvalue()
    assert "Ingested 1 files" in text and "[1]" in text
    assert [json.loads(x) for x in text.splitlines() if x.startswith("{")] == [{"discovered": 1, "ingested": 0, "due": 1, "skipped": 0}, {"discovered": 1, "ingested": 1, "due": 1, "skipped": 0}, {"discovered": 1, "ingested": 0, "due": 0, "skipped": 1}]


# --- streams ----------------------------------------------------------------------------

EV = "id bigint, session_id string, agent string, ts double, type string, role string, content string, name string, args_json string, result string, error string, metadata_json string"


def stream_of(spark, tmp_path, *batches):
    """A file stream with one file for each batch of events."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        base = dict(id=0, session_id="x", agent="a", ts=0.0, type="message", role="user", content="", name="", args_json="", result="", error="", metadata_json="")
        df = spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in EV.split(", ")) for r in rows], EV)
        df.coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(EV).option("maxFilesPerTrigger", 1).json(str(folder))


def run(df, spark, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    hour = 3600.0
    rows = [[dict(id=1, ts=10.0, content="I prefer tabs"), dict(id=2, ts=10.0, content="I prefer tabs"), dict(id=3, ts=20.0, role="", content="yes")], [dict(id=4, ts=30.0, type="session_end")], [dict(id=5, ts=5 * hour, session_id="y", content="late")], [dict(id=6, ts=9 * hour, session_id="z", content="later")]]
    s = stream_of(spark, tmp_path, *rows)
    assert {r.event_id for r in run(capture.fire(s), spark, "fired")} == {1, 2}
    timed = capture.with_time(s)
    assert {r.id for r in run(capture.distinct(timed), spark, "uniq")} in ({1, 3, 4, 5, 6}, {2, 3, 4, 5, 6})
    n = run(capture.counts(timed), spark, "counts")
    assert sum(r.n for r in n if r.type == "message" and r.start.timestamp() % hour == 0) >= 3
    w = run(capture.session_windows(timed), spark, "windows")
    assert ("x", 3) in {(r.session_id, r.messages) for r in w}
    f = run(capture.flush_sessions(timed), spark, "flushed")
    assert [(r.session_id, r.messages, r.summary) for r in f] == [("x", 3, "[user] I prefer tabs\n[user] I prefer tabs\n[unknown] yes")]


def test_watched_files_come_again_when_modified(spark, tmp_path):
    import os

    spark.dataSource.register(WatchedFiles)
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    (folder / "b.bin").write_text("no")
    from recollect.streaming.watch import _Reader

    r = _Reader({"path": str(folder)})
    start = r.initialOffset()
    assert list(r.read(start)[0]) == []  # what is there at the start is not new
    rows, end = _Reader({"path": str(folder), "existing": "true"}).read({"until": 0.0})
    assert [x[3] for x in rows] == ["one"]
    (folder / "a.md").write_text("two")
    os.utime(folder / "a.md", (end["until"] + 5, end["until"] + 5))
    rows, later = r.read(end)
    assert [x[3] for x in rows] == ["two"] and [x[3] for x in r.readBetweenOffsets(end, later)] == ["two"]
    q = spark.readStream.format("watched_files").option("path", str(folder)).option("existing", "true").load().writeStream.format("memory").queryName("watched").start()
    try:
        q.processAllAvailable()
        assert [x.content for x in spark.table("watched").collect()] == ["two"]
    finally:
        q.stop()


def test_listings_page_through_all_and_reports_name_every_pair(spark, tmp_path, monkeypatch):
    server = rpc.Server(spark, str(tmp_path / "v"))
    server.vault.init()
    for n in range(3):
        server.ak_ingest({"text": f"# Note {n}\n\n## decisions\n- We adopted the warm cache number {n} for the relay.\n", "title": f"Note {n}"})
    monkeypatch.setattr(rpc, "PAGE", 2)
    seen, cursor = [], ""
    while True:
        page = server.handle({"id": 1, "method": "resources/list", "params": {"cursor": cursor}})["result"]
        assert len(page["resources"]) <= 2
        seen += [r["uri"] for r in page["resources"]]
        cursor = page.get("nextCursor")
        if not cursor:
            break
    want = {f"ak://entities/{r.id}" for r in server.vault.load("entities").collect()} | {f"ak://sources/{r.id}" for r in server.vault.load("sources").collect()}
    assert len(seen) == len(set(seen)) and set(seen) == want and len([u for u in seen if "sources" in u]) == 3
    assert server.handle({"id": 2, "method": "resources/list", "params": {"cursor": "x"}})["error"]["code"] == -32602
    claims = spark.createDataFrame(
        [(f"c{i}", "e", f"claim {i}", "active", p, 0.9) for i, p in enumerate(["positive"] * 3 + ["negative"] * 2 + ["neutral"])], "id string, entity_id string, text string, status string, polarity string, confidence double"
    )
    names = spark.createDataFrame([("e", "Relay")], "id string, name string")
    monkeypatch.setattr(server.vault, "load", lambda n: {"claims": claims, "entities": names}[n])
    report = server.contradictions()
    assert "6 contradicting pair(s)" in report and "Relay" in report and all(f"claim {i}" in report for i in range(5)) and "claim 5" not in report
