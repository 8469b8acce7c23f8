"""H0 to H6: hooks as predicates with projections; each event can fire several.

``events`` is the event table; a hook's row is (event_id, hook, session_id, text, tags, durability,
confidence).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T


@dataclass(frozen=True)
class Hook:
    """A hook's name, when it fires and what it makes of an event."""

    name: str
    fires: Callable[[], Column]
    text: Callable[[], Column]
    tags: Callable[[], Column]
    durability: Callable[[], Column]
    confidence: float


def _s(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _tags(*pairs: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*(F.when(cond, tag) for cond, tag in pairs)), lambda t: t.isNotNull())


def _content(pattern: str) -> Column:
    return T.signal(_s("content"), pattern)


def _message() -> Hook:
    fires = lambda: (F.col("type") == "message") & _s("role").isin("", "user") & (F.length(_s("content")) >= 5) & (_content(L.PREFERENCE) | _content(L.DIRECTIVE) | _content(L.HOOK_FORESIGHT))
    tags = lambda: _tags((_content(L.PREFERENCE), F.lit("preference")), (_content(L.DIRECTIVE), F.lit("directive")), (_content(L.HOOK_FORESIGHT), F.lit("foresight")))
    return Hook("message", fires, lambda: _s("content"), tags, lambda: F.when(_content(L.HOOK_FORESIGHT), "temporary").otherwise("stable"), 0.5)


def _response() -> Hook:
    fires = lambda: (F.col("type") == "message") & (F.col("role") == "assistant") & (F.length(_s("content")) >= 5) & (_content(L.COMMITMENT) | _content(L.CORRECTION))
    tags = lambda: _tags((_content(L.CORRECTION), F.lit("correction")), (_content(L.COMMITMENT), F.lit("commitment")))
    return Hook("response", fires, lambda: _s("content"), tags, lambda: F.when(_content(L.CORRECTION), "stable").otherwise("temporary"), round(0.7 / 1.7, 3))


def _tool() -> Hook:
    def text() -> Column:
        args = F.array_join(F.transform(F.slice(F.map_entries(F.from_json("args_json", "map<string,string>")), 1, 5), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ", ")
        keys = F.slice(T.all_matches(F.substring(_s("result"), 1, 2000), "(?i)" + L.RESULT_KEYS, 1), 1, 5)
        return F.concat_ws(" | ", F.concat(F.lit("Tool: "), "name"), F.when(args != "", F.concat(F.lit("Args: "), args)), F.when(F.size(keys) > 0, F.concat(F.lit("Keys: "), F.array_join(keys, ", "))))

    return Hook("tool_use", lambda: (F.col("type") == "tool_use") & (_s("name") != ""), text, lambda: F.array(F.lit("tool_use"), F.col("name")), lambda: F.lit("temporary"), 0.5)


def _error() -> Hook:
    def text() -> Column:
        said = F.when(_s("error") != "", F.col("error")).otherwise(_s("content"))
        context = F.get_json_object("metadata_json", "$.context")
        return F.concat_ws(" | ", F.concat(F.lit("Error: "), said), F.when(_s("name") != "", F.concat(F.lit("Tool: "), "name")), F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("Context: "), context)))

    return Hook("error", lambda: (F.col("type") == "error") & ((_s("error") != "") | (_s("content") != "")), text, lambda: F.array(F.lit("error"), F.lit("pitfall")), lambda: F.lit("stable"), 0.5)


def _decision() -> Hook:
    fires = lambda: F.col("type").isin("decision", "message") & (F.length(_s("content")) >= 5) & _content(L.HOOK_DECISION)
    return Hook("decision", fires, lambda: _s("content"), lambda: F.array(F.lit("decision")), lambda: F.lit("stable"), 0.85)


def _session() -> Hook:
    messages = lambda: F.from_json(F.get_json_object("metadata_json", "$.messages"), "array<struct<role:string,text:string>>")

    def text() -> Column:
        line = lambda m: F.when(F.coalesce(m["text"], F.lit("")) != "", F.concat(F.lit("["), F.coalesce(m["role"], F.lit("unknown")), F.lit("] "), F.substring(m["text"], 1, 200)))
        return F.substring(F.array_join(F.transform(messages(), line), "\n"), 1, 5000)

    return Hook("session", lambda: (F.col("type") == "session_end") & (F.coalesce(F.size(messages()), F.lit(0)) >= 2), text, lambda: F.array().cast("array<string>"), lambda: F.lit("unknown"), 0.0)


BUILT_IN = (_message(), _response(), _tool(), _error(), _decision(), _session())


class Registry:
    """Hooks by name; a later one of the same name replaces an earlier."""

    def __init__(self, hooks: tuple[Hook, ...] = BUILT_IN):
        self.hooks = {h.name: h for h in hooks}

    def register(self, hook: Hook) -> None:
        self.hooks[hook.name] = hook

    def fire(self, events: DataFrame) -> DataFrame:
        """H0: a row for each event and hook that fires on it, in one pass over the events."""
        cells = [
            F.when(F.coalesce(h.fires(), F.lit(False)), F.struct(F.lit(h.name).alias("hook"), F.substring(h.text(), 1, 500).alias("text"), h.tags().alias("tags"), h.durability().alias("durability"), F.lit(h.confidence).alias("confidence")))
            for h in self.hooks.values()
        ]
        fired = events.select(F.col("id").alias("event_id"), "session_id", F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("h"))
        return fired.select("event_id", "session_id", "h.*")

    def counts(self, events: DataFrame) -> DataFrame:
        """Fire counts by hook."""
        return self.fire(events).groupBy("hook").agg(F.count("*").alias("fired"))


def session_summaries(events: DataFrame, limit: int = 5000, least: int = 2) -> DataFrame:
    """H5 over the table itself: (session_id, messages, summary) of ended sessions.

    The lines ``[role] text`` of a session's messages in time order, up to ``limit`` characters.
    Only the first messages can show, so each session passes on as many as could fill the
    limit: a bounded number, however long the session is.
    """
    from pyspark.sql import Window

    ended = events.where("type = 'session_end' and session_id <> ''").select("session_id").distinct()
    said = events.where("type = 'message' and session_id <> '' and content <> ''").join(ended, "session_id", "left_semi")
    counts = said.groupBy("session_id").agg(F.count("*").alias("messages")).where(F.col("messages") >= least)
    line = F.concat(F.lit("["), F.when(_s("role") != "", F.col("role")).otherwise("unknown"), F.lit("] "), F.substring("content", 1, 200))
    w = Window.partitionBy("session_id").orderBy("ts", "id")
    first = said.select("session_id", "ts", "id", line.alias("line")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit // 5)
    text = first.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("ls"))
    return text.join(counts, "session_id").select("session_id", "messages", F.substring(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), 1, limit).alias("summary"))
