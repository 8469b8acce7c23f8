"""Event capture as streams: hooks, windowed counts, duplicates and ended sessions.

Event time is ``at``, a timestamp; ``with_time`` makes it of unix seconds or milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.operators import hooks

#: Characters of a session's summary and of one of its lines, messages it needs.
SUMMARY_CHARS, LINE_CHARS, LEAST = 5000, 200, 2


def with_time(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with ``at`` and a watermark on it."""
    seconds = F.when(F.col("ts") >= 1e11, F.col("ts") / 1000).otherwise(F.col("ts"))
    return events.withColumn("at", F.timestamp_seconds(seconds)).withWatermark("at", late)


def fire(events: DataFrame, registry: hooks.Registry | None = None) -> DataFrame:
    """H0 on a stream: stateless, so each event's rows leave at once."""
    return (registry or hooks.Registry()).fire(events)


def distinct(events: DataFrame, keys: tuple[str, ...] = ("session_id", "ts", "role", "content")) -> DataFrame:
    """Events sent again within the watermark, once."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def counts(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """E5 over time: events by window, type and agent; final when the watermark passes."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    n = events.groupBy(w.alias("w"), "type", "agent").agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "type", "agent", "n")


def session_windows(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions by silence: (session_id, start, end, messages)."""
    said = events.where("type = 'message'")
    n = said.groupBy(F.session_window("at", gap).alias("w"), "session_id").agg(F.count("*").alias("messages"))
    return n.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "messages")


def _lines(pdfs: Iterator[pd.DataFrame]) -> tuple[list[tuple[float, int, str]], bool]:
    lines, ended = [], False
    for pdf in pdfs:
        for r in pdf.itertuples():
            if r.type == "session_end":
                ended = True
            elif r.type == "message" and r.content:
                lines.append((float(r.ts), int(r.id), f"[{r.role or 'unknown'}] {r.content[:LINE_CHARS]}"))
    return lines, ended


def flush_sessions(events: DataFrame, timeout: str = "30 minutes") -> DataFrame:
    """H5 on a stream: (session_id, messages, summary) of each session when it ends.

    A session ends with a ``session_end`` event, or when nothing came for ``timeout`` of event
    time.  The state of a session is the first lines that fit its summary, so it is bounded
    however long the session runs.
    """
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def f(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: list[list] = []
        n = 0
        if state.exists:
            n, stored = state.get
            kept = [list(x) for x in zip(*stored)] if stored and stored[0] else []
        over = state.hasTimedOut
        if not over:
            new, over = _lines(pdfs)
            n += len(new)
            kept = sorted([*map(tuple, kept), *new])
            size, cut = 0, len(kept)
            for i, (_, _, line) in enumerate(kept):
                size += len(line) + 1
                if size > SUMMARY_CHARS:
                    cut = i + 1
                    break
            kept = kept[:cut]
        if over:
            state.remove()
            if n >= LEAST:
                yield pd.DataFrame({"session_id": [key[0]], "messages": [n], "summary": ["\n".join(x[2] for x in kept)[:SUMMARY_CHARS]]})
            return
        state.update((n, ([x[0] for x in kept], [x[1] for x in kept], [x[2] for x in kept])))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + ms)

    rows = events.where("session_id <> '' and type in ('message', 'session_end')").select("session_id", "id", "ts", "type", "role", "content", "at")
    return rows.groupBy("session_id").applyInPandasWithState(
        f, "session_id string, messages bigint, summary string", "n bigint, kept struct<ts:array<double>,id:array<bigint>,line:array<string>>", "append", GroupStateTimeout.EventTimeTimeout
    )


def append_to(vault, events: DataFrame, checkpoint: str):
    """E1 on a stream: every batch is appended to the vault's event table; returns the query."""

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("id", F.sha2(F.concat_ws("\x1f", F.lit(str(batch_id)), *(F.col(c).cast("string") for c in batch.columns)), 256))
        vault.save("events", rows)

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
