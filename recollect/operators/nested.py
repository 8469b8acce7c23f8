"""Deeply nested documents as related flat tables.

Method: Dewey labelling.  Every object that is an element of a list becomes a node.  Its
label lists the steps from node to node on the way down, such as ``.events[3]`` then
``.args.edits[0]``; the label's prefix without the last step is its parent's label, so the
parent link is a truncation and never a join.  Nodes whose labels agree but for the
positions share a schema path, and each schema path is a table.

Labels are assigned in one narrow pass: JSON of unknown depth and fields has no fixed
schema, so the documents are parsed in Arrow batches; all else is column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of the document that hold a list and may be delivered as a lone object.
LISTS = ("actors", "events")
#: Fields that hold an object and may be delivered as JSON text.
AS_TEXT = ("args", "metadata", "context")

_NODES = "steps array<string>, schema_steps array<string>, fields map<string,string>"


def _no_constant(name: str):
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_constant=_no_constant)
_scalar = re.compile(r"\s*(?:([\[\]{},:])|(\"))|\s*([^\s\[\]{},:\"]+)")


def _parse_deep(text: str):
    """Like the decoder, without recursion, for documents nested beyond its limit."""
    root: list = []
    stack: list = [root]
    keys: list = [None]
    expect, at = "value", 0

    def put(value):
        if isinstance(stack[-1], list):
            stack[-1].append(value)
        else:
            stack[-1][keys[-1]] = value

    while m := _scalar.match(text, at):
        mark, quote, plain = m.groups()
        at = m.end()
        if quote or plain:
            if quote:
                value, at = json.decoder.scanstring(text, at, True)
            else:
                value = _decoder.decode(plain)
            if expect in ("key", "first key") and quote:
                keys[-1], expect = value, "colon"
            elif expect in ("value", "first value"):
                put(value)
                expect = "comma"
            else:
                raise ValueError(text[:20])
        elif mark in "[{" and expect in ("value", "first value"):
            new: list | dict = [] if mark == "[" else {}
            put(new)
            stack.append(new)
            keys.append(None)
            expect = "first value" if mark == "[" else "first key"
        elif mark in "]}" and len(stack) > 1 and expect in ("comma", "first value" if mark == "]" else "first key") and isinstance(stack[-1], list) == (mark == "]"):
            stack.pop()
            keys.pop()
            expect = "comma"
        elif mark == ":" and expect == "colon":
            expect = "value"
        elif mark == "," and expect == "comma" and len(stack) > 1:
            expect = "value" if isinstance(stack[-1], list) else "key"
        else:
            raise ValueError(mark)
    if text[at:].strip(" \t\r\n") or len(root) != 1 or len(stack) != 1:
        raise ValueError("not one value")
    return root[0]


def parse(text: str | None):
    """The value of a JSON text; ValueError if it isn't valid JSON."""
    if not text:
        raise ValueError("empty")
    try:
        return _decoder.decode(text)
    except RecursionError:
        return _parse_deep(text)


def _object_in(text: str):
    try:
        value = parse(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _clean(text: str) -> str:
    """Lone surrogates, which no UTF-8 text can hold, as replacement characters."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text


def _show(value) -> str | None:
    """A scalar as text: strings as they are, others as JSON."""
    return None if value is None else _clean(value) if isinstance(value, str) else json.dumps(value)


def nodes_of(document) -> Iterator[tuple[list[str], list[str], dict[str, str | None]]]:
    """(steps, schema steps, own fields) of each node in document order, the root first.

    A node's own fields are the scalars in it and in the objects below it that are no
    list elements, by their path; lists of scalars are JSON text.
    """
    # (value, steps, schema steps, path and schema path since the last node, fields, is an element, role)
    root: dict = {}
    found = [([], [], root)]
    stack = [(document, [], [], "", "", root, False, "root")]
    while stack:
        value, steps, schema, path, shape, fields, element, role = stack.pop()
        if isinstance(value, dict):
            if element:
                steps, schema, path, shape, fields = [*steps, path], [*schema, shape], "", "", {}
                found.append((steps, schema, fields))
            below = []
            for key, child in value.items():
                name = _clean(key)
                kind = "event" if role == "events" else ""
                if isinstance(child, str) and (key == "context" if role == "root" else key in AS_TEXT[:2] and role == "events"):
                    child = v if (v := _object_in(child)) is not None else child
                if role == "root" and key in LISTS:
                    kind = key
                    child = [child] if isinstance(child, dict) else child
                if isinstance(child, (dict, list)):
                    below.append((child, steps, schema, f"{path}.{name}", f"{shape}.{name}", fields, False, kind))
                else:
                    fields[f"{path}.{name}"[1:]] = _show(child)
            stack += reversed(below)
        elif isinstance(value, list):
            below = []
            for i, child in enumerate(value):
                if isinstance(child, (dict, list)):
                    below.append((child, steps, schema, f"{path}[{i}]", f"{shape}[]", fields, True, role if role in LISTS else ""))
            if not below and value:
                fields[f"{path}"[1:] or "[]"] = _clean(json.dumps(value, ensure_ascii=False))
            stack += reversed(below)
    return iter(found)


def label(df: DataFrame, key: str = "umsf_id", payload: str = "payload") -> DataFrame:
    """(key, steps, schema_steps, fields): a row per node of each document, root included.

    The root has no steps.  A lone object in ``actors`` or ``events`` is element 0; JSON
    text in the document's ``context`` and an event's ``args`` and ``metadata`` counts as the
    object it holds.  Null elements keep their position and give no node.  Payloads that
    are null, empty or not valid JSON give no row; NaN and Infinity are not JSON.  Of
    equal keys in an object the last counts.  Documents delivered twice are labelled twice.
    """
    from recollect.functions.arrow import batch_mapper

    def explode(keys: list, payloads: list):
        out: tuple[list, list, list, list] = ([], [], [], [])
        for k, text in zip(keys, payloads):
            try:
                document = parse(text)
            except ValueError:
                continue
            for steps, schema, fields in nodes_of(document):
                for column, value in zip(out, (k, steps, schema, list(fields.items()))):
                    column.append(value)
        return out

    kind = df.schema[key].dataType.simpleString()
    return batch_mapper(df, [F.col(f"`{key}`"), F.col(f"`{payload}`")], f"`{key}` {kind}, {_NODES}", explode)


def path_of(steps: Column) -> Column:
    return F.concat(F.lit("$"), F.array_join(steps, ""))


def parent_of(steps: Column) -> Column:
    """The path of a label without its last step."""
    return path_of(F.slice(steps, 1, F.size(steps) - 1))


def links(labelled: DataFrame, key: str = "umsf_id") -> DataFrame:
    """(key, node, parent) of every node but the roots."""
    steps = F.col("steps")
    return labelled.where(F.size(steps) > 0).select(f"`{key}`", path_of(steps).alias("node"), parent_of(steps).alias("parent"))


def flat(labelled: DataFrame, key: str = "umsf_id") -> DataFrame:
    """(key, table_path, node, parent, position, fields): all tables in one relation.

    ``table_path`` is the schema path, ``$`` for the documents; ``position`` is the element's
    position in its list.
    """
    steps, root = F.col("steps"), F.size("steps") == 0
    return labelled.select(
        f"`{key}`",
        path_of(F.col("schema_steps")).alias("table_path"),
        path_of(steps).alias("node"),
        F.when(~root, parent_of(steps)).alias("parent"),
        F.when(~root, F.regexp_extract(F.element_at(steps, -1), r"\[(\d+)\]$", 1).cast("int")).alias("position"),
        "fields",
    )


def table_at(flattened: DataFrame, table_path: str, columns: dict[str, str], key: str = "umsf_id") -> DataFrame:
    """One table: the nodes at a schema path, with chosen fields as typed columns.

    ``columns`` gives each column's field path; fields that are absent are null.
    """
    return flattened.where(F.col("table_path") == table_path).select(
        f"`{key}`", "node", "parent", "position", *(F.try_element_at("fields", F.lit(path)).alias(name) for name, path in columns.items())
    )


def schema_paths(flattened: DataFrame) -> DataFrame:
    """(table_path, rows, parents): the tables a corpus has."""
    return flattened.groupBy("table_path").agg(F.count("*").alias("rows"), F.count("parent").alias("children"))
