"""Event documents from JSON, their validation and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T

EVENT = (
    "struct<type:string,ts:double,role:string,content:string,name:string,args:string,result:string,error:string,path:string,before:string,after:string,rationale:string,metadata:string>"
)


def parse(raw: DataFrame, key: str = "umsf_id", payload: str = "payload") -> DataFrame:
    """(key, ok, schema, agent, ..., actors, events, body): documents with known fields.

    Payloads are read as VARIANT, so a lone object where a list is expected, JSON text where
    an object is expected, null elements and unknown fields all come out as defined: one
    element, the object, nothing, nothing.  ``ok`` is false for payloads that are no JSON
    object; their fields are null.
    """
    v = F.try_parse_json(payload)
    doc = raw.select(key, v.alias("v"))
    get = lambda path, kind="string", of="v": F.try_variant_get(of, path, kind)
    kind = F.schema_of_variant("v")
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    lists = []
    for name in ("actors", "events"):
        x = F.try_variant_get("v", f"$.{name}", "variant")
        k = F.schema_of_variant(x)
        lists.append(F.when(k.startswith("ARRAY"), F.try_variant_get("v", f"$.{name}", "array<variant>")).when(k.startswith("OBJECT"), F.array(x)).otherwise(F.array().cast("array<variant>")).alias(name))
        lists.append((x.isNull() | k.startswith("ARRAY") | k.startswith("OBJECT") | (k == "VOID")).alias(f"{name}_ok"))
    context = F.coalesce(F.try_parse_json(get("$.context")), F.try_variant_get("v", "$.context", "variant"))
    head = doc.select(
        key, is_object.alias("ok"), *(get(f"$.{c}").alias(c) for c in ("schema", "agent", "agent_version", "source_type", "session_id", "title", "summary")), get("$.occurred_at", "double").alias("occurred_at"), *lists, context.alias("context"),
    )
    fields = [f.split(":") for f in EVENT[7:-1].split(",")]
    event = lambda e: F.struct(*(F.try_variant_get(e, f"$.{n}", t).alias(n) for n, t in fields))
    actor = lambda a: F.struct(F.try_variant_get(a, "$.role", "string").alias("role"), F.try_variant_get(a, "$.id", "string").alias("id"))
    present = lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))
    return head.select(
        *(c for c in head.columns if c not in ("actors", "events", "context")), F.try_variant_get("context", "$.body", "string").alias("body"),
        F.transform(F.filter("actors", present), actor).alias("actors"), F.transform(F.filter("events", present), event).alias("events"),
    )


def problem(parsed: DataFrame) -> Column:
    """why a document is rejected; null if it isn't.  Unknown event types are allowed."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(~F.col("ok"), "not a document")
        .when(~F.coalesce(F.coalesce("schema", F.lit("ak/v1")).startswith("ak/"), F.lit(False)), "unknown schema")
        .when(~F.coalesce(F.coalesce("source_type", F.lit("conversation")).isin(*L.SOURCE_TYPES), F.lit(False)), "unknown source type")
        .when(~F.col("events_ok"), "events is no list")
        .when(~F.col("actors_ok"), "actors is no list")
        .when((F.size("events") == 0) & empty("summary") & empty("body"), "nothing to ingest")
    )


def validate(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reason``)."""
    judged = parsed.withColumn("reason", problem(parsed))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def args_summary(args: Column) -> Column:
    """The first three arguments of a JSON object, each cut at sixty characters."""
    # keys keep their order of writing only in the text, so the text is read as a map in order
    pairs = F.map_entries(F.from_json(args, "map<string,string>"))

    def one(e: Column) -> Column:
        v = e["value"]
        nested = F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(True))
        return F.concat(e["key"], F.lit("="), F.when(nested, "…").when(F.length(v) > 60, F.concat(F.substring(v, 1, 60), F.lit("…"))).otherwise(v))

    shown = F.transform(F.slice(pairs, 1, 3), one)
    return F.coalesce(F.array_join(F.when(F.size(pairs) >= 3, F.concat(shown, F.array(F.lit("…")))).otherwise(shown), ", "), F.lit(""))


def derived_title() -> Column:
    """U4: the document's title, the summary's first sentence, or agent, type and session."""
    head = T.strip(F.substring_index(T.strip(F.col("summary")), ".", 1))
    parts = F.filter(
        F.array("agent", "source_type", F.when(F.coalesce("session_id", F.lit("")) != "", F.concat(F.lit("session "), F.substring("session_id", 1, 8)))), lambda p: F.coalesce(p, F.lit("")) != ""
    )
    return F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).when((F.length(head) > 6) & (F.length(head) < 100), head).otherwise(F.array_join(parts, " · "))


def render(parsed: DataFrame, key: str = "umsf_id") -> DataFrame:
    """(key, markdown): documents as the markdown that claim extraction reads.

    One expression per document over its array of events; nothing is exploded or shuffled.
    """
    s = lambda c: F.coalesce(c, F.lit(""))

    def of(types: tuple[str, ...], line) -> Column:
        return F.transform(F.filter("events", lambda e: e["type"].isin(*types)), line)

    def section(head: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(head)), lines)).otherwise(F.array().cast("array<string>"))

    def either(*cs: Column) -> Column:
        out = F.lit("")
        for c in reversed(cs):
            out = F.when(s(c) != "", c).otherwise(out)
        return out

    decision = lambda e: F.concat(F.lit("- "), T.strip(s(e["content"])), F.when(s(e["rationale"]) != "", F.concat(F.lit(" — rationale: "), T.strip(s(e["rationale"])))).otherwise(""))
    used = lambda e: F.when(s(e["name"]) != "", F.concat(F.lit("- "), e["name"], F.lit("("), args_summary(e["args"]), F.lit(")"))).otherwise(F.concat(F.lit("- "), T.strip(s(e["content"]))))
    got = lambda e: F.concat(F.lit("- result: "), F.substring(F.replace(T.strip(either(e["result"], e["error"], e["content"])), F.lit("\n"), F.lit(" ")), 1, 200))
    action = lambda e: F.when(e["type"] == "tool_use", used(e)).otherwise(got(e))
    changed = lambda e: F.rtrim(F.concat(F.lit("- "), either(e["name"], F.lit("modified")), F.lit(" "), s(e["path"])))
    risk = lambda e: F.when(T.strip(either(e["content"], e["error"])) != "", F.concat(F.lit("- "), F.substring(T.strip(either(e["content"], e["error"])), 1, 300))).otherwise("")
    said = lambda e: F.when(T.strip(s(e["content"])) != "", F.concat(F.lit("**"), either(e["role"], F.lit("speaker")), F.lit("**: "), T.strip(s(e["content"])))).otherwise("")
    title = derived_title()
    head = F.when(title != "", F.array(F.concat(F.lit("# "), title))).otherwise(F.array().cast("array<string>"))
    summary = F.when(s(F.col("summary")) != "", F.array(F.lit("## summary"), T.strip(F.col("summary")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(
        head, summary, section("## decisions", of(("decision",), decision)), section("## actions", of(("tool_use", "tool_result"), action)), section("## actions", of(("file_change",), changed)),
        section("## risks", of(("error",), risk)), section("## conversation", of(("message",), said)),
    )
    curated = F.concat(head, F.array(T.strip(either(F.col("body"), F.col("summary")))))
    chosen = F.when(F.col("source_type") == "curated_memory", curated).otherwise(parts)
    return parsed.select(key, F.array_join(F.filter(chosen, lambda p: p != ""), "\n\n").alias("markdown"))
