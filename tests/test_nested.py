import json

import pytest

from recollect.operators import nested


def links(spark, *payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "umsf_id bigint, payload string").withColumnRenamed("payload", "payload")
    return {(r.umsf_id, r.node, r.parent) for r in nested.links(nested.label(df)).collect()}


def test_nodes_and_parents(spark):
    doc = {"events": [{"args": {"edits": [{"x": 1}, None, {"y": [{}]}]}}, None, {"metadata": '{"blocks": [{"a": 1}]}'}], "actors": {"role": "user"}, "x": {"deep": [[{"k": 1}]]}, "context": '{"files": [{}]}'}
    assert links(spark, json.dumps(doc)) == {
        (0, "$.events[0]", "$"), (0, "$.events[0].args.edits[0]", "$.events[0]"), (0, "$.events[0].args.edits[2]", "$.events[0]"),
        (0, "$.events[0].args.edits[2].y[0]", "$.events[0].args.edits[2]"), (0, "$.events[2]", "$"), (0, "$.events[2].metadata.blocks[0]", "$.events[2]"),
        (0, "$.actors[0]", "$"), (0, "$.x.deep[0][0]", "$"), (0, "$.context.files[0]", "$"),
    }


def test_what_is_no_document(spark):
    assert links(spark, None, "", "   ", "{", "[1", '"text"', "NaN", '{"a": NaN}', "null", "[]", "{}", '{"events": null}', '{"events": []}') == set()


def test_lone_event_text_fields_and_odd_keys(spark):
    assert links(spark, '{"events": {"args": "{\\"l\\": [{}]}", "content": "[{}]"}}') == {(0, "$.events[0]", "$"), (0, "$.events[0].args.l[0]", "$.events[0]")}
    assert links(spark, '{"a.b": [{}], "": [{}], "\\ud800": [{}]}') == {(0, "$.a.b[0]", "$"), (0, "$.[0]", "$"), (0, "$.�[0]", "$")}


def test_very_deep_documents_have_rows(spark):
    deep = '{"a":[' * 3000 + "{}" + "]}" * 3000
    assert len(list(nested.nodes_of(nested.parse(deep)))) == 3001
    with pytest.raises(ValueError):
        nested.parse(deep[:-1])


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, null, "x\\n"], "b": {"c": []}}', "[[], {}, [{}]]", '"s"', "12", '{"a":{"b":{"c":[{"d":1}]}}}'])
def test_deep_parser_agrees(text):
    assert nested._parse_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "[1,]", "[,1]", "{,}", '{"a" 1}', '{"a":1,}', "[1 2]", "[1]]", "{]", '{"a":}', "tru", "[1]x", '{1:2}'])
def test_deep_parser_rejects(text):
    with pytest.raises(ValueError):
        nested._parse_deep(text)


def test_tables(spark):
    raw = spark.createDataFrame([(7, '{"agent": "x", "events": [{"type": "message", "args": {"n": 1, "tags": ["a", 2]}}]}'), (7, '{"events": [{}]}')], "umsf_id bigint, payload string")
    flat = nested.flat(nested.label(raw.withColumn("steps", raw.umsf_id)))
    events = nested.table_at(flat, "$.events[]", {"type": "type", "n": "args.n", "none": "nope"}).orderBy("type").collect()
    assert [(e.node, e.parent, e.position, e.type, e.n, e.none) for e in events] == [("$.events[0]", "$", 0, None, None, None), ("$.events[0]", "$", 0, "message", "1", None)]
    assert flat.where("table_path = '$' and fields['agent'] = 'x'").count() == 1
    assert {r.table_path: r["rows"] for r in nested.schema_paths(flat).collect()} == {"$": 2, "$.events[]": 2}


def test_empty_table(spark):
    assert nested.links(nested.label(spark.createDataFrame([], "umsf_id bigint, payload string"))).count() == 0
