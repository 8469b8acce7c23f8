"""Text files, markdown memories and transcripts."""

from __future__ import annotations

import codecs
import locale
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions.arrow import batch_mapper

#: Characters of a transcript event's text.
EVENT_CHARS = 1500
#: Transcript rows that hold no event (fixed values).
SKIPPED = ("permission-mode", "file-history-snapshot", "last-prompt", "attachment", "summary", "meta")
#: Memory files of known agents by folder and name, with their role (fixed values).
MEMORY_FILES = {
    "hermes": (("MEMORY.md", "memory"), ("USER.md", "user_profile"), ("SOUL.md", "persona"), ("AGENTS.md", "workspace_instructions")),
    "openclaw": (("MEMORY.md", "memory"), ("USER.md", "user_profile"), ("SOUL.md", "persona"), ("AGENTS.md", "workspace_instructions")),
    "claude-code": (("CLAUDE.md", "workspace_instructions"), ("MEMORY.md", "memory")),
    "codex": (("AGENTS.md", "workspace_instructions"),),
}


def decode(data: bytes | None) -> str | None:
    """UTF-8, without a byte order mark, else in the locale's encoding."""
    if data is None:
        return None
    if data.startswith(codecs.BOM_UTF8):
        data = data[3:]
    for encoding in ("utf-8", locale.getpreferredencoding(False)):
        try:
            return data.decode(encoding)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("utf-8", "replace")


def list_files(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, size, mtime): files by glob, without their contents."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(paths if isinstance(paths, str) else list(paths))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))


def read_texts(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.md", recursive: bool = True) -> DataFrame:
    """(path, title, content, size, mtime): whole files as text, title from the name.

    A file that can't be decoded comes out with replacement characters; it fails no other.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(paths if isinstance(paths, str) else list(paths))
    columns = [F.col("path"), F.col("length"), F.col("modificationTime").cast("double").alias("mtime"), F.col("content")]
    read = batch_mapper(files, columns, "path string, size bigint, mtime double, content string", lambda p, s, m, c: (p, s, m, [decode(x) for x in c]))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return read.select("path", stem.alias("title"), "content", "size", "mtime")


def fingerprint(size: Column, mtime: Column) -> Column:
    return F.concat_ws(":", size.cast("string"), mtime.cast("string"))


def markdown_memories(spark: SparkSession, roots: dict[str, str], custom: Sequence[str] = ()) -> DataFrame:
    """(adapter, id, fingerprint, agent, role, title, body): the agents' memory files.

    ``roots`` maps agents to their folders; ``custom`` are more files.  Empty files are left out.
    """
    out = None
    for agent, root in roots.items():
        names = dict(MEMORY_FILES.get(agent, ()))
        if not names:
            continue
        role = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        found = read_texts(spark, root, "*.md", recursive=False).withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").isin(list(names)))
        found = found.select("path", "content", "size", "mtime", F.lit(agent).alias("agent"), F.element_at(role, F.col("name")).alias("role"))
        out = found if out is None else out.unionByName(found)
    if custom:
        found = read_texts(spark, list(custom), "*", recursive=False).select("path", "content", "size", "mtime", F.lit("custom").alias("agent"), F.lit("memory").alias("role"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "adapter string, id string, fingerprint string, agent string, role string, title string, body string")
    return out.where(T.strip(F.col("content")) != "").select(
        F.lit("markdown-memory").alias("adapter"), F.col("path").alias("id"), fingerprint(F.col("size"), F.col("mtime")).alias("fingerprint"), "agent", "role",
        F.concat(F.lit("["), "agent", F.lit("] "), F.element_at(F.split("path", "/"), -1)).alias("title"), F.col("content").alias("body"),
    )


def _capped(text: Column) -> Column:
    return F.when(F.length(text) > EVENT_CHARS, F.concat(F.substring(text, 1, EVENT_CHARS - 1), F.lit("…"))).otherwise(text)


def transcript_events(lines: DataFrame, thinking: bool = False) -> DataFrame:
    """C11: (path, line, block, session_id, ts, type, role, content, name, args, result, error, metadata).

    ``lines`` is (path, line, value): rows of JSON text.  Malformed rows, rows without a type and
    those of a skipped type are dropped.  ``content`` is a text or a list of blocks; blocks
    are text, thinking (on demand), tool_use, tool_result and unknown, which stay as
    empty messages.
    """
    v = lines.select("path", "line", F.try_parse_json("value").alias("v"))
    get = lambda of, path, kind="string": F.try_variant_get(of, path, kind)
    rows = v.select(
        "path", "line", get("v", "$.type").alias("who"), get("v", "$.sessionId").alias("session_id"), get("v", "$.timestamp").alias("at"),
        F.try_variant_get("v", "$.message.content", "variant").alias("c"),
    ).where(F.col("who").isin("user", "assistant"))
    kind = F.schema_of_variant("c")
    ts = F.coalesce(F.try_to_timestamp("at").cast("double"), F.lit(0.0))
    none = F.lit(None).cast("string")
    said = rows.where(kind == "STRING").withColumn("content", T.strip(F.col("c").cast("string"))).where("content <> ''")
    said = said.select("path", "line", F.lit(0).alias("block"), "session_id", ts.alias("ts"), F.lit("message").alias("type"), F.col("who").alias("role"), _capped(F.col("content")).alias("content"),
                       F.lit("").alias("name"), none.alias("args"), F.lit("").alias("result"), F.lit("").alias("error"), none.alias("metadata"))
    blocks = rows.where(kind.startswith("ARRAY")).select("path", "line", "session_id", ts.alias("ts"), "who", F.posexplode(F.col("c").cast("array<variant>")).alias("block", "b")).where(F.schema_of_variant("b").startswith("OBJECT"))
    t = get("b", "$.type")
    result = F.try_variant_get("b", "$.content", "variant")
    parts = F.try_variant_get("b", "$.content", "array<variant>")
    flat = F.array_join(F.filter(F.transform(parts, lambda p: F.when(F.schema_of_variant(p) == "STRING", p.cast("string")).when(F.try_variant_get(p, "$.type", "string") == "text", F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))), lambda p: p.isNotNull()), "\n")
    text = F.when(F.schema_of_variant(result).startswith("ARRAY"), flat).otherwise(F.coalesce(get("b", "$.content"), F.lit("")))
    failed = F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False))
    body = F.when(t == "text", T.strip(F.coalesce(get("b", "$.text"), F.lit("")))).when(t == "thinking", T.strip(F.coalesce(get("b", "$.thinking"), F.lit("")))).otherwise("")
    keep = F.when(t == "text", body != "").when(t == "thinking", F.lit(thinking) & (body != "")).otherwise(F.lit(True))
    meta = (
        F.when(t == "thinking", F.to_json(F.struct(F.lit(True).alias("is_thinking"))))
        .when(t == "tool_use", F.to_json(F.struct(F.coalesce(get("b", "$.id"), F.lit("")).alias("tool_use_id"))))
        .when(t == "tool_result", F.to_json(F.struct(F.coalesce(get("b", "$.tool_use_id"), F.lit("")).alias("tool_use_id"))))
        .when(~F.coalesce(t == "text", F.lit(False)), F.to_json(F.struct(F.coalesce(t, F.lit("None")).alias("unknown_block_type"))))
    )
    is_call = t.isin("tool_use", "tool_result")
    made = blocks.where(F.coalesce(keep, F.lit(True))).select(
        "path", "line", "block", "session_id", "ts", F.when(F.coalesce(is_call, F.lit(False)), t).otherwise("message").alias("type"), F.when(F.coalesce(is_call, F.lit(False)), "").otherwise(F.col("who")).alias("role"), _capped(body).alias("content"),
        F.when(t == "tool_use", F.coalesce(get("b", "$.name"), F.lit(""))).otherwise("").alias("name"), F.when(t == "tool_use", F.to_json(F.try_variant_get("b", "$.input", "variant"))).alias("args"),
        F.when((t == "tool_result") & ~failed, _capped(text)).otherwise("").alias("result"), F.when((t == "tool_result") & failed, _capped(text)).otherwise("").alias("error"), meta.alias("metadata"),
    )
    return said.unionByName(made)


def read_transcripts(spark: SparkSession, paths: str | Sequence[str], project: str | None = None, since: float | None = None, limit: int | None = None, thinking: bool = False) -> DataFrame:
    """C11, F8: events of JSONL transcripts, by folder, age and newest first."""
    files = list_files(spark, paths, "*.jsonl")
    if project:
        files = files.where(F.element_at(F.split("path", "/"), -2).contains(project))
    if since is not None:
        files = files.where(F.col("mtime") >= since)
    if limit is not None:
        files = files.orderBy(F.col("mtime").desc(), "path").limit(limit)
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(paths if isinstance(paths, str) else list(paths))
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), "value").where("trim(value) <> ''")
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = rows.withColumn("path", same(F.col("path"))).join(files.select(same(F.col("path")).alias("path")), "path", "left_semi")
    return transcript_events(rows, thinking)


def transcript_titles(events: DataFrame) -> DataFrame:
    """(path, title): the first user text, cut at eighty characters."""
    first = events.where("type = 'message' and role = 'user' and content <> ''").groupBy("path").agg(F.min(F.struct("line", "block", "content"))["content"].alias("c"))
    return first.select("path", F.concat(F.substring("c", 1, 80), F.when(F.length("c") > 80, "…").otherwise("")).alias("title"))
