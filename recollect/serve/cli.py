"""The command line: ``python -m recollect.serve.cli COMMAND VAULT ...``."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import functions as F

from recollect.plans import ingest
from recollect.serve import rpc
from recollect.session import local_session
from recollect.sources import files, pull
from recollect.sources.vault import Vault


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recollect")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help)
        c.add_argument("vault")
        return c

    command("init", "make a vault").add_argument("--lang", default="zh", choices=["zh", "en"])
    c = command("ingest", "take in a text or file")
    c.add_argument("--file", "-f")
    c.add_argument("--text", "-t")
    c = command("query", "search")
    c.add_argument("query")
    c.add_argument("--top-k", type=int, default=5)
    command("stats", "count rows")
    command("dream", "consolidate").add_argument("--hours", type=float, default=24.0)
    c = command("batch-ingest", "take in the files of a folder")
    c.add_argument("source_dir")
    c.add_argument("--pattern", default="*.md")
    command("mcp", "serve JSON-RPC on standard input and output")
    c = command("hooks", "watch a folder or fire an event")
    c.add_argument("--watch")
    c.add_argument("--interval", type=float, default=5.0)
    c.add_argument("--fire")
    c = command("pull", "take in new and changed items of an adapter")
    c.add_argument("--adapter", default="markdown-memory", choices=["markdown-memory", "transcripts"])
    c.add_argument("--root", action="append", default=[], help="agent=folder, or a folder of transcripts")
    c.add_argument("--path", action="append", default=[], help="further files")
    c.add_argument("--project")
    c.add_argument("--since-days", type=float)
    c.add_argument("--limit", type=int)
    c.add_argument("--force", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    command("lint", "check for contradictions")
    return p


def _pull(vault: Vault, a) -> dict:
    """Discover, compare with the state, take in what is due, keep the new state."""
    spark = vault.spark
    if a.adapter == "markdown-memory":
        roots = dict(r.split("=", 1) for r in a.root)
        items = files.markdown_memories(spark, roots, a.path)
        content = items.select("adapter", "id", "fingerprint", "title", F.col("body").alias("content"), F.lit("curated_memory").alias("source_type"))
    else:
        since = time.time() - a.since_days * 86400 if a.since_days is not None else None
        events = files.read_transcripts(spark, a.root, a.project, since, a.limit)
        said = events.where("content <> ''").withColumn("line_text", F.concat(F.lit("**"), "role", F.lit("**: "), "content"))
        body = said.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "block", "line_text"))), lambda x: x["line_text"]), "\n\n").alias("content"))
        stamps = files.list_files(spark, a.root, "*.jsonl").select(F.regexp_replace("path", "^file:/+", "/").alias("path"), files.fingerprint(F.col("size"), F.col("mtime")).alias("fingerprint"))
        titles = files.transcript_titles(events)
        content = body.join(stamps, "path").join(titles, "path", "left").select(F.lit("transcripts").alias("adapter"), F.col("path").alias("id"), "fingerprint", F.coalesce("title", "path").alias("title"), "content", F.lit("conversation").alias("source_type"))
    state = vault.load("pull_state").select("adapter", "id", "fingerprint")
    due = pull.due(content, state, a.force).persist()
    found, n = content.count(), due.count()
    if not a.dry_run and n:
        ingest.texts(vault, due)
        vault.save("pull_state", due.select("id", "adapter", "fingerprint"))
    due.unpersist()
    return {"discovered": found, "ingested": 0 if a.dry_run else n, "due": n, "skipped": found - n}


def _watch(vault: Vault, a) -> None:
    from recollect.streaming.watch import WatchedFiles

    vault.spark.dataSource.register(WatchedFiles)
    stream = vault.spark.readStream.format("watched_files").option("path", a.watch).load()
    save = lambda batch, _: ingest.texts(vault, batch.select(F.col("path").alias("title"), "content", F.lit("file").alias("source_type")))
    stream.writeStream.foreachBatch(save).trigger(processingTime=f"{a.interval} seconds").start().awaitTermination()


def main(argv: list[str] | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    spark = local_session("*", "recollect-cli")
    vault = Vault(spark, a.vault, getattr(a, "lang", "zh"))
    say = lambda *x: print(*x, file=out)
    if a.command != "init" and a.command != "mcp" and not vault.is_initialized:
        say(f"no vault at {a.vault}; run init first")
        return 1
    server = rpc.Server(spark, a.vault)
    text = lambda reply: reply["content"][0]["text"]
    if a.command == "init":
        vault.init()
        say(f"vault at {a.vault}")
    elif a.command == "ingest":
        if a.file:
            r = files.read_texts(spark, a.file, "*", recursive=False).first()
            say(text(server.ak_ingest({"text": r.content, "title": r.title, "source_type": "file"})))
        else:
            say(text(server.ak_ingest({"text": a.text or ""})))
    elif a.command == "query":
        say(text(server.ak_query({"query": a.query, "top_k": a.top_k})))
    elif a.command == "stats":
        say(text(server.ak_stats({})))
    elif a.command == "dream":
        say(text(server.ak_dream({"since_hours": a.hours})))
    elif a.command == "batch-ingest":
        docs = files.read_texts(spark, a.source_dir, a.pattern).withColumn("source_type", F.lit("file"))
        say(f"Ingested {ingest.texts(vault, docs).count()} files")
    elif a.command == "mcp":
        rpc.run(spark, a.vault)
    elif a.command == "hooks":
        if a.watch:
            _watch(vault, a)
        elif a.fire:
            event = json.loads(a.fire)
            say(text(server.ak_ingest_umsf({"doc": event}) if "events" in event else server.ak_hook_fire(event)))
        else:
            say(text(server.ak_hook_list({})))
    elif a.command == "pull":
        say(json.dumps(_pull(vault, a)))
    elif a.command == "lint":
        say(server.contradictions())
        say(text(server.ak_stats({})))
    return 0


if __name__ == "__main__":
    sys.exit(main())
