"""One surviving record for each group of duplicate facts.

Method: token-level consensus.  A record is a sequence of tokens: the words of its text,
each with its spelling, followed by one token for each valued field.  The records of a
group are aligned progressively (profile to profile), every column of the alignment is
voted on with weighted tokens, and the record closest to the consensus survives.  In word
columns a token's votes add up.  In field columns a token's vote is its value, and the
strongest vote wins, so the consensus holds the most complete, recent and trusted value
of each field, and the closest record is the one that misses the fewest of them; spelling
decides only between records that miss equally many.

The groups of ``survivors`` hold the same words in the same order, as the duplicates of the
tables are defined, so their alignment is the identity and the field columns decide.
``consensus`` runs the method on wider groups, whose records differ in words: all records
that name the same things.

A hot group is never brought together: equal spellings are added up first, what is left
is aligned in salted parts of bounded size, and only the parts' profiles meet.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.session import cut_lineage

#: Distinct spellings that one task aligns at most on average; more are salted into parts.
PART = 1000

WORD = r"[\p{L}\p{M}\p{N}]+"
#: A word with the marks before it; white space counts as one blank.
PIECE = r"[^\p{L}\p{M}\p{N}]*[\p{L}\p{M}\p{N}]+"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + "  "


def narrow(text: Column) -> Column:
    """Full-width forms as ASCII; format characters (zero width, BOM) removed."""
    return F.regexp_replace(F.translate(text, _WIDE, _NARROW), r"\p{Cf}", "")


def words(text: Column) -> Column:
    """The words of a text in order: case, spacing, punctuation, markup and width removed."""
    return F.regexp_extract_all(F.lower(narrow(text)), F.lit(WORD), F.lit(0))


def pieces(text: Column) -> Column:
    """The words as spelt, each with the marks before it; as many as ``words`` finds."""
    return F.transform(F.regexp_extract_all(narrow(text), F.lit(PIECE), F.lit(0)), lambda p: F.regexp_replace(p, r"\s+", " "))


# --- profiles -------------------------------------------------------------------------
# A profile is a list of columns; a column maps a word to {spelling: weight}, and "" to
# the weight of the records that have no word there.


def as_profile(norms: Iterable[str], spelt: Iterable[str], weight: float) -> list[dict]:
    return [{n: {s: weight}} for n, s in zip(norms, spelt)]


def _total(column: dict) -> float:
    return sum(sum(spellings.values()) for spellings in column.values())


def _merge(a: dict, b: dict) -> dict:
    out = {n: dict(s) for n, s in a.items()}
    for n, spellings in b.items():
        own = out.setdefault(n, {})
        for s, w in spellings.items():
            own[s] = own.get(s, 0.0) + w
    return out


def _likeness(a: dict, b: dict) -> float:
    """Share of the pairs of records, one from each side, that have the same word."""
    same = sum(sum(a[n].values()) * sum(b[n].values()) for n in a if n and n in b)
    return same / (_total(a) * _total(b))


def align(a: list[dict], b: list[dict], weight_a: float, weight_b: float) -> list[dict]:
    """Global alignment of two profiles; columns without a partner get gaps.

    Profiles of the same words column by column need no search.
    """
    if len(a) == len(b) and all(x.keys() == y.keys() for x, y in zip(a, b)):
        return [_merge(x, y) for x, y in zip(a, b)]
    n, m, gap = len(a), len(b), -0.5
    best = [[j * gap for j in range(m + 1)]]
    for i in range(1, n + 1):
        row = [i * gap]
        for j in range(1, m + 1):
            row.append(max(best[i - 1][j - 1] + 2 * _likeness(a[i - 1], b[j - 1]) - 1, best[i - 1][j] + gap, row[j - 1] + gap))
        best.append(row)
    out, i, j = [], n, m
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + 2 * _likeness(a[i - 1], b[j - 1]) - 1:
            out.append(_merge(a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i and best[i][j] == best[i - 1][j] + gap:
            out.append(_merge(a[i - 1], {"": {"": weight_b}}))
            i -= 1
        else:
            out.append(_merge({"": {"": weight_a}}, b[j - 1]))
            j -= 1
    return out[::-1]


def vote(profile: list[dict]) -> list[str]:
    """The heaviest word of each column in its heaviest spelling; ties by spelling."""
    out = []
    for column in profile:
        word = min(column, key=lambda n: (-round(sum(column[n].values()), 9), n))
        if word:
            out.append(min(column[word], key=lambda s: (-round(column[word][s], 9), s)))
    return out


def _fold(parts: Iterable[tuple[list[dict], float]]) -> tuple[list[dict], float]:
    profile, weight = [], 0.0
    for other, w in parts:
        profile, weight = (align(profile, other, weight, w) if weight else other), weight + w
    return profile, weight


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns, one run at a time."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, run in groupby(rows, lambda row: row[:keys]):
        yield key, [row[keys:] for row in run]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    while chunk := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*chunk), schema)], schema=schema)


_PARTS = pa.schema([("group", pa.string()), ("part", pa.int32()), ("weight", pa.float64()), ("profile", pa.string())])
_VOTED = pa.schema([("group", pa.string()), ("consensus", pa.list_(pa.string()))])


def _align_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts():
        for (group, part), run in _runs(batches, 2):
            run.sort(key=lambda r: (-r[2], r[1]))
            profile, weight = _fold((as_profile(n, s, w), w) for n, s, w in run)
            yield group, part, weight, json.dumps(profile)

    yield from _batches(parts(), _PARTS)


def _align_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def groups():
        for (group,), run in _runs(batches, 1):
            profile, _ = _fold((json.loads(p), w) for _, w, p in sorted(run))
            yield group, vote(profile)

    yield from _batches(groups(), _VOTED)


def text_consensus(values: DataFrame) -> DataFrame:
    """(group, consensus array<string>): the voted text of each group.

    ``values`` has (group, norms, spelt, weight, parts): distinct spellings with the sum
    of their weights, and into how many parts their group is salted.
    """
    salted = values.select("group", F.pmod(F.xxhash64("spelt"), F.col("parts")).cast("int").alias("part"), "norms", "spelt", "weight")
    parts = salted.repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(_align_parts, "group string, part int, weight double, profile string")
    return parts.repartition("group").sortWithinPartitions("group").mapInArrow(_align_groups, "group string, consensus array<string>")


def _filled(c: str, kind: str) -> Column:
    if kind.startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind == "string":
        return F.coalesce(F.col(c) != "", F.lit(False))
    return F.col(c).isNotNull()


def _value(c: str) -> Column:
    """Numbers as votes: missing and NaN below any other."""
    return F.when(F.col(c).isNull() | F.isnan(c), F.lit(float("-inf"))).otherwise(F.col(c).cast("double"))


def exactly(norms: Column) -> Column:
    """The group of a record: its words in their order."""
    return F.md5(F.array_join(norms, " "))


def by_names(norms: Column) -> Column:
    """A wider group: what the record names, i.e. its words of letters and digits and its long
    numbers; null for a record that names nothing."""
    names = F.filter(norms, lambda w: w.rlike(r"^(?=.*\d)(?=.*[a-z]).{5,}$|^\d{5,}$"))
    return F.when(F.size(names) > 0, F.md5(F.array_join(F.array_sort(F.array_distinct(names)), " ")))


def grouped_facts(facts: DataFrame, claims: DataFrame, group: Callable[[Column], Column] = exactly) -> DataFrame:
    """The records that have a duplicate: (group, fact_id, fact, norms, spelt, votes, weight).

    Duplicates hold the same words in the same order.  Rows delivered twice count once
    (of rows with one ``fact_id``, the greatest counts), rows without ``fact_id`` or words
    have no group.  ``votes`` has the tokens of the four field columns.
    """
    kinds = dict(facts.dtypes)
    own = facts.select("fact_id", "fact", "entities", "source", "timestamp", "supersedes", "weight", "claim_id").where("fact_id is not null and fact is not null")
    fields = ("entities", "source", "timestamp", "supersedes", "weight", "claim_id")
    own = own.withColumn("filled", sum((_filled(c, kinds[c]).cast("int") for c in fields), F.lit(0)))
    own = own.withColumn("norms", words(F.col("fact"))).where(F.size("norms") > 0)
    own = own.select(
        group(F.col("norms")).alias("group"), "fact_id", "claim_id",
        F.struct(F.col("filled").cast("double").alias("filled"), _value("timestamp").alias("timestamp"), _value("weight").alias("weight"), "fact").alias("r"),
    )
    one = own.where("group is not null").groupBy("group", "fact_id").agg(F.max(F.struct("r", "claim_id")).alias("x")).select("group", "fact_id", "x.claim_id", "x.r.*")
    several = one.groupBy("group").agg(F.count("*").alias("records")).where("records > 1")
    trust = claims.where("id is not null").groupBy("id").agg(F.max(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("confidence"))
    return (
        one.join(several, "group")
        .join(trust.withColumnRenamed("id", "claim_id"), "claim_id", "left")
        .select(
            "group", "fact_id", "fact", "records",
            words(F.col("fact")).alias("norms"), pieces(F.col("fact")).alias("spelt"),
            F.array("filled", "timestamp", "weight", _value("confidence")).alias("votes"),
            F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(0.0)).alias("trust"),
        )
    )


def spellings(records: DataFrame, sizes: DataFrame, part: int) -> DataFrame:
    """The distinct spellings of each group with their weights; ``sizes`` has (group, n)."""
    own = records.groupBy("group", "spelt").agg(F.first("norms").alias("norms"), F.sum(F.col("trust") + 0.01).alias("weight"))
    return own.join(sizes.select("group", F.ceil(F.col("n") / part).alias("parts")), "group")


def survivors(facts: DataFrame, claims: DataFrame, part: int = PART) -> DataFrame:
    """(group, fact_id, fact, consensus, missed, respelt, records): one row per group.

    ``consensus`` is the voted text, ``missed`` the number of field columns in which the
    survivor differs from the consensus, ``respelt`` the number of words it spells
    differently.  Ties go to the smallest ``fact_id``.  Groups of one record, null,
    empty and wordless facts give no row.
    """
    records = cut_lineage(grouped_facts(facts, claims))  # read four times below
    fields = records.groupBy("group").agg(F.array(*(F.max(F.col("votes")[i]) for i in range(4))).alias("best"), F.count("*").alias("n"))
    votes = text_consensus(spellings(records, fields, part))
    compared = (
        records.join(fields, "group")
        .join(votes, "group")
        .withColumn("missed", F.size(F.filter(F.arrays_zip("votes", "best"), lambda x: x["votes"] != x["best"])))
        .withColumn("respelt", F.size(F.filter(F.arrays_zip("spelt", "consensus"), lambda x: ~x["spelt"].eqNullSafe(x["consensus"]))))
    )
    closest = compared.groupBy("group").agg(
        F.min(F.struct("missed", "respelt", "fact_id", "fact")).alias("s"), F.first("consensus").alias("c"), F.first("records").alias("records")
    )
    return closest.select("group", "s.fact_id", "s.fact", F.array_join("c", "").alias("consensus"), "s.missed", "s.respelt", "records")


def consensus(facts: DataFrame, claims: DataFrame, part: int = PART) -> DataFrame:
    """(group, fact_id, fact, consensus, distance, texts, records): one row per group of records that name the same things.

    ``consensus`` is the aligned and voted text, ``fact`` the existing text closest to it,
    ``distance`` their edit distance in characters, ``texts`` the number of different word
    sequences.  Ties go to the smallest ``fact_id``.  Groups of one record, records that name
    nothing, null, empty and wordless facts give no row.
    """
    records = cut_lineage(grouped_facts(facts, claims, by_names))
    sizes = records.groupBy("group").agg(F.count("*").alias("n"))
    # distinct in two steps, so that a hot group is counted by its texts
    texts = records.select("group", F.md5(F.array_join("norms", " ")).alias("t")).distinct().groupBy("group").agg(F.count("*").alias("texts"))
    votes = text_consensus(spellings(records, sizes, part))
    near = records.join(votes, "group").withColumn("distance", F.levenshtein(F.array_join("spelt", ""), F.array_join("consensus", "")))
    best = near.groupBy("group").agg(F.min(F.struct("distance", "fact_id", "fact")).alias("s"), F.first("consensus").alias("c"), F.first("records").alias("records"))
    return best.join(texts, "group").select("group", "s.fact_id", "s.fact", F.array_join("c", "").alias("consensus"), "s.distance", "texts", "records")
