"""Conversations from message rows.

Two operators.  ``assemble`` is the overlap method: a session reaches the store as export
fragments that may overlap; suffix-prefix matches of message hashes give an overlap graph
per session, unambiguous paths are merged and sessions with gaps are dropped.  It works on
equalities of hash sums only (no pairs within a session are formed), because messages
inside a fragment are in time order, so equal sums over equal counts from an equal first
message are equal sequences.

``judge`` and ``turns`` follow the messages' own times: they order, pair and number the
messages of a session and say which sessions are broken.  Rows that arrive late lie
between the messages of a fragment and overlap with nothing, so the overlap graph alone
cannot find their place; that is why the rows of ``p5_found`` come from ``judge``.

A session may hold a third of all rows: it is cut into stretches of time, each judged on
its own, and only the stretches' first and last speakers are compared across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import cut_lineage

#: Times from here on are milliseconds (fixed value; as seconds, the year 5138).
MILLISECONDS_FROM = 1e11
#: Seconds of a stretch.
STRETCH = 3600.0
#: Rows of a session loaded within so many seconds arrived in one export.
EXPORT_SECONDS = 3600

USER_ROLES = ["user", "human"]
ASSISTANT_ROLES = ["assistant", "ai", "model"]


def speaker(role: Column) -> Column:
    """'user', 'assistant', 'none' for a null or blank role, else 'other'."""
    r = F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))
    return (
        F.when(r.isNull() | (r == ""), "none").when(r.isin(USER_ROLES), "user").when(r.isin(ASSISTANT_ROLES), "assistant").otherwise("other")
    )


def seconds(ts: Column) -> Column:
    """Unix seconds of a time that may be in milliseconds."""
    return F.when(ts >= MILLISECONDS_FROM, ts / 1000).otherwise(ts)


def is_message() -> Column:
    """Rows of type 'message' with a content that is not blank."""
    return (F.col("type") == "message") & F.coalesce(F.col("content").rlike(r"(?U)\S"), F.lit(False))


def _sessions(events: DataFrame) -> DataFrame:
    return events.where("session_id is not null and session_id <> ''")


def _messages(events: DataFrame, *more: Column) -> DataFrame:
    """Distinct messages (session_id, ts, role, hash, id, ...) and, with a null hash, one
    row for each session: one pass over the events and one shuffle."""
    m = F.coalesce(is_message(), F.lit(False))
    own = lambda c: F.when(m, c)
    rows = _sessions(events).select(
        "session_id", own(F.col("ts")).alias("ts"), own(F.col("role")).alias("role"), own(F.md5("content")).alias("hash"), own(F.col("id")).alias("id"), *more
    )
    return rows.groupBy("session_id", "ts", "role", "hash").agg(F.min("id").alias("id"), *(F.first(n).alias(n) for n in rows.columns[5:]))


def judge(events: DataFrame, stretch: float = STRETCH) -> DataFrame:
    """(session_id, no_role, no_user, no_assistant, assistant_first, unanswered, broken).

    One row for each session that is neither null nor empty; ``broken`` if any of the
    others holds.  Messages with equal (session, ts, role, content) are one; they are
    ordered by ts (null first), then by id.  System, tool and unknown roles are ignored.
    """
    rows = _messages(events).withColumn("who", F.when(F.col("hash").isNotNull(), speaker(F.col("role"))))
    rows = rows.withColumn("t", seconds(F.col("ts"))).withColumn("stretch", F.floor(F.col("t") / stretch))
    talk = F.col("who").isin("user", "assistant")
    # within a stretch: whom does each message precede?  Rows that are no talk sort last.
    order = Window.partitionBy("session_id", "stretch").orderBy(talk.desc_nulls_last(), F.col("t").asc_nulls_first(), "id")
    rows = rows.withColumn("then", F.lead("who").over(order))
    place = F.struct(F.col("t"), F.col("id"), F.col("who"))
    part = rows.groupBy("session_id", "stretch").agg(
        F.min(F.when(talk, place)).alias("first"),
        F.max(F.when(talk, place)).alias("last"),
        F.max((F.col("who") == "user") & (F.col("then") == "user")).alias("twice"),
        F.max(F.col("who") == "none").alias("none"),
        F.max(F.col("who") == "user").alias("user"),
        F.max(F.col("who") == "assistant").alias("assistant"),
    )
    across = Window.partitionBy("session_id").orderBy(F.col("first").isNull(), F.col("stretch").asc_nulls_first())
    part = part.withColumn("next", F.lead("first.who").over(across))
    no = F.lit(False)
    session = part.groupBy("session_id").agg(
        F.coalesce(F.max("none"), no).alias("no_role"),
        (~F.coalesce(F.max("user"), no)).alias("no_user"),
        (~F.coalesce(F.max("assistant"), no)).alias("no_assistant"),
        F.coalesce(F.min("first")["who"] == "assistant", no).alias("assistant_first"),
        F.coalesce(F.max(F.coalesce("twice", no) | ((F.col("last.who") == "user") & F.coalesce(F.col("next") == "user", F.lit(True)))), no).alias("unanswered"),
    )
    faults = [c for c in session.columns if c != "session_id"]
    broken = no
    for c in faults:
        broken = broken | F.col(c)
    return session.withColumn("broken", broken)


def turns(events: DataFrame, stretch: float = STRETCH) -> DataFrame:
    """(session_id, turn, speaker, ts, content): the messages of sound sessions in order.

    ``turn`` counts from 1 within a session, over messages of all speakers ('system' and
    'tool' keep their role in lower case); ``ts`` is in seconds.
    """
    sound = judge(events, stretch).where("not broken").select("session_id")
    m = _sessions(events).where(is_message()).select("session_id", "ts", "role", "content", "id", F.md5("content").alias("hash"))
    m = m.groupBy("session_id", "ts", "role", "hash").agg(F.min("id").alias("id"), F.first("content").alias("content"))
    m = m.join(sound, "session_id", "left_semi").withColumn("t", seconds(F.col("ts"))).withColumn("stretch", F.floor(F.col("t") / stretch))
    sizes = m.groupBy("session_id", "stretch").agg(F.count("*").alias("n"))
    over = Window.partitionBy("session_id").orderBy(F.col("stretch").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.select("session_id", F.col("stretch").alias("s"), (F.sum("n").over(over) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("session_id", "stretch").orderBy(F.col("t").asc_nulls_first(), "id"))
    placed = m.withColumn("within", within).alias("m").join(sizes.alias("z"), (F.col("m.session_id") == F.col("z.session_id")) & F.col("m.stretch").eqNullSafe(F.col("z.s")))
    who = speaker(F.col("role"))
    return placed.select(
        "m.session_id", (F.col("before") + F.col("within")).alias("turn"), F.when(who == "other", F.lower(F.trim("role"))).otherwise(who).alias("speaker"), F.col("t").alias("ts"), "content"
    )


def _hash() -> Column:
    """A message's hash, in 40 bits."""
    return F.pmod(F.xxhash64("ts", "role", "content"), F.lit(1 << 40))


def fragments(events: DataFrame, export_seconds: int = EXPORT_SECONDS) -> DataFrame:
    """Messages in their export fragments: (session_id, fragment, pos, length, t, h, upto, total).

    A fragment holds the distinct messages of a session that were loaded in one interval
    of ``export_seconds``, in time order.  ``h`` is the message's hash, ``upto`` the sum of the
    fragment's hashes up to it and ``total`` the whole sum (each hash has 40 bits, so the
    sums of 8 million messages fit).
    """
    m = _sessions(events).where(is_message()).select(
        "session_id", F.floor(F.unix_timestamp("loaded_at") / export_seconds).alias("fragment"), F.coalesce(seconds(F.col("ts")), F.lit(0.0)).alias("t"),
        _hash().alias("h"),
    ).where("fragment is not null").distinct()
    # prefix sums in stretches of time, so that a large fragment is summed by many tasks
    m = m.withColumn("stretch", F.floor(F.col("t") / 60))
    parts = m.groupBy("session_id", "fragment", "stretch").agg(F.sum("h").alias("s"), F.count("*").alias("n"))
    whole = Window.partitionBy("session_id", "fragment")
    run = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select(
        "session_id", "fragment", "stretch", (F.sum("s").over(run) - F.col("s")).alias("s0"), (F.sum("n").over(run) - F.col("n")).alias("n0"),
        F.sum("s").over(whole).alias("total"), F.sum("n").over(whole).alias("length"),
    )
    inside = Window.partitionBy("session_id", "fragment", "stretch").orderBy("t", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.withColumn("s", F.sum("h").over(inside)).withColumn("n", F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(
        parts, ["session_id", "fragment", "stretch"]
    ).select("session_id", "fragment", (F.col("n0") + F.col("n")).alias("pos"), "length", "t", "h", (F.col("s0") + F.col("s")).alias("upto"), "total")


def _overlaps(events: DataFrame, export_seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fragments, those contained in another, and the unambiguous overlaps (session_id, a, b, common).

    An overlap is a suffix of fragment a that is a prefix of b; it is unambiguous if it is the only
    one at both its ends.
    """
    f = cut_lineage(fragments(events, export_seconds))
    first = f.where("pos = 1").select("session_id", "h", F.col("fragment").alias("b"), F.col("length").alias("b_length"), F.col("total").alias("b_total"))
    # places in fragment a where fragment b's first message stands
    met = f.join(first, ["session_id", "h"]).where("fragment <> b").select(
        "session_id", F.col("fragment").alias("a"), "pos", "length", F.col("total").alias("a_total"), (F.col("upto") - F.col("h")).alias("before"), "b", "b_length", "b_total"
    )
    at = f.select("session_id", F.col("fragment").alias("a"), F.col("pos").alias("end"), F.col("upto").alias("end_upto"))
    inside = (
        met.withColumn("end", F.col("pos") + F.col("b_length") - 1).join(at, ["session_id", "a", "end"])
        .where("end_upto - before = b_total and (b_length < length or a < b)")  # of equal fragments the first stays
        .select("session_id", "b").distinct()
    )
    of_b = f.select("session_id", F.col("fragment").alias("b"), F.col("pos").alias("common"), F.col("upto").alias("b_upto"))
    overlaps = (
        met.withColumn("common", F.col("length") - F.col("pos") + 1).where("common < b_length")
        .join(of_b, ["session_id", "b", "common"]).where("a_total - before = b_upto")
        .join(inside, ["session_id", "b"], "left_anti")
        .join(inside.withColumnRenamed("b", "a"), ["session_id", "a"], "left_anti")
        .groupBy("session_id", "a", "b").agg(F.max("common").alias("common"))
    )
    only = lambda c: overlaps.groupBy("session_id", c).agg(F.count("*").alias("n")).where("n = 1").select("session_id", c)
    return f, inside, overlaps.join(only("a"), ["session_id", "a"], "left_semi").join(only("b"), ["session_id", "b"], "left_semi")


def _verdicts(f: DataFrame, inside: DataFrame, sure: DataFrame) -> DataFrame:
    """(session_id, fragments, contained, merged, gaps, kept)."""
    merged = sure.groupBy("session_id").agg(F.count("*").alias("merged"))
    per = f.where("pos = 1").groupBy("session_id").agg(F.count("*").alias("fragments"))
    lost = inside.groupBy("session_id").agg(F.count("*").alias("contained"))
    zero = F.lit(0)
    return (
        per.join(lost, "session_id", "left").join(merged, "session_id", "left")
        .select("session_id", "fragments", F.coalesce("contained", zero).alias("contained"), F.coalesce("merged", zero).alias("merged"))
        .withColumn("gaps", F.col("fragments") - F.col("contained") - F.col("merged") - 1)
        .withColumn("kept", F.col("gaps") == 0)
    )


def assemble(events: DataFrame, export_seconds: int = EXPORT_SECONDS) -> DataFrame:
    """(session_id, fragments, contained, merged, gaps, kept): the overlap graph's verdict.

    Of a session's ``fragments``, those whose messages all lie in a row in another one are
    ``contained``; ``merged`` counts the unambiguous overlaps between the others; ``gaps`` the
    breaks that remain.  Unambiguous overlaps join each fragment to at most one before and
    one after it and lead forward in time, so they form paths, and one less of them than of
    fragments is a single path: the session is ``kept``.  Sessions without messages give no row.
    """
    return _verdicts(*_overlaps(events, export_seconds))


def merged(events: DataFrame, export_seconds: int = EXPORT_SECONDS) -> DataFrame:
    """(session_id, turn, speaker, ts, content): the conversations of the kept sessions, merged along their paths.

    A fragment's messages follow those of the fragment before it, less their overlap, so
    ``turn`` is the place in the merged sequence.
    """
    f, inside, sure = _overlaps(events, export_seconds)
    kept = _verdicts(f, inside, sure).where("kept").select("session_id")
    path = f.where("pos = 1").join(inside.withColumnRenamed("b", "fragment"), ["session_id", "fragment"], "left_anti").join(kept, "session_id", "left_semi")
    path = path.select("session_id", "fragment", "length", "t", "h").join(sure.select("session_id", F.col("b").alias("fragment"), "common"), ["session_id", "fragment"], "left")
    # one row for each fragment, in the order of their first messages: how many messages stand before it, and how many of its own came before
    along = Window.partitionBy("session_id").orderBy("t", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    common = F.coalesce(F.col("common"), F.lit(0))
    path = path.select("session_id", "fragment", common.alias("common"), (F.sum(F.col("length") - common).over(along) - F.col("length")).alias("before"))
    placed = f.join(path, ["session_id", "fragment"]).where("pos > common").select("session_id", (F.col("before") + F.col("pos")).alias("turn"), "h")
    m = _sessions(events).where(is_message()).select("session_id", _hash().alias("h"), "role", seconds(F.col("ts")).alias("ts"), "content")
    texts = m.groupBy("session_id", "h").agg(F.min(F.struct("ts", "role", "content")).alias("m"))
    who = speaker(F.col("m.role"))
    named = F.when(who == "other", F.lower(F.trim("m.role"))).otherwise(who)
    return placed.join(texts, ["session_id", "h"]).select("session_id", "turn", named.alias("speaker"), "m.ts", "m.content")
