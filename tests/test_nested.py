import json
from datetime import datetime

import pytest

from marlstone.operators import nested

MODEL = "model_id bigint, bounded_contexts array<struct<context_name:string,description:string,allowed_dependencies:array<string>,ubiquitous_language:struct<entities:array<struct<name:string,description:string,synonyms_to_avoid:array<string>>>,value_objects:array<struct<name:string,attributes:array<string>,description:string>>,domain_events:array<string>>>>, loaded_at timestamp_ntz, _key string"


def context(entities=None, values=None):
    return ("C", None, ["D", None], (entities, values, ["E"]))


def tables(spark, models, payloads):
    m = spark.createDataFrame([(i, c, datetime(2025, 1, 1), "x") for i, c in models], MODEL)
    p = spark.createDataFrame(payloads, "model_id bigint, payload string")
    return nested.model_tables(m, p)


def test_typed_levels(spark, rows):
    models = [(1, [context([("A", None, ["x", None, " ", "y"]), None, ("B", None, [])], [("V", ["p", "p"], None)]), None]), (2, None), (3, [])]
    t = tables(spark, [*models, models[0]], [])
    assert rows(nested.model_leaves(t)) == sorted([(1, 0, "entity", 0, "synonym", 0, "x"), (1, 0, "entity", 0, "synonym", 3, "y"), (1, 0, "value_object", 0, "attribute", 0, "p"), (1, 0, "value_object", 0, "attribute", 1, "p")], key=repr)
    contexts = t["bounded_contexts"].select("model_id", "row_key", "parent_key", "f_context_name").collect()
    assert sorted(r["row_key"] for r in contexts) == [f"{contexts[0]['parent_key']}/bounded_contexts:{i}" for i in (0, 1)] and contexts[0]["parent_key"].startswith("1#")
    deps = t["bounded_contexts.allowed_dependencies"].collect()
    first = min(r["row_key"] for r in contexts)
    assert [(r["parent_key"], r["value"]) for r in sorted(deps, key=lambda r: r["row_key"])] == [(first, "D"), (first, None)]


def test_deliveries_and_fields_of_payloads_are_kept(spark, rows):
    one = {"bounded_contexts": [{"context_name": "A", "Owner-Team": "t1", "ubiquitous_language": {"entities": [{"name": "X", "attributes": [{"name": "a", "type": "int", "tags": ["p", "q"]}]}], "identity": {"key": 5}}}]}
    two = {"bounded_contexts": [{"context_name": "A", "ubiquitous_language": {"entities": [{"name": "X", "attributes": ["b"]}]}}]}
    t = tables(spark, [(1, [context([("Y", None, ["s"])])])], [(9, json.dumps(one)), (9, json.dumps(two)), (9, json.dumps(two))])
    assert len({r["row_key"] for r in t["bounded_contexts"].collect()}) == 3 and {r["f_other_owner_team"] for r in t["bounded_contexts"].collect()} == {None, "t1"}
    assert {r["f_ubiquitous_language_other_identity_key"] for r in t["bounded_contexts"].collect()} == {None, 5}
    leaves = {(r["f_name"], r["f_other_type"]) for r in t["bounded_contexts.ubiquitous_language_entities.attributes"].collect()}
    assert leaves == {("a", "int"), ("b", None)} and [r["value"] for r in t["bounded_contexts.ubiquitous_language_entities.attributes.other_tags"].orderBy("row_key").collect()] == ["p", "q"]
    assert [r["value"] for r in t["bounded_contexts.ubiquitous_language_entities.synonyms_to_avoid"].collect()] == ["s"]
    assert rows(nested.broken_links(t)) == [(0, 0, 0)]


def found(spark, rows, payload):
    return rows(nested.model_leaves(tables(spark, [], [(9, payload)])).drop("model_id"))


BASE = {"project_name": "P", "boundedContexts": {"One": {"ContextName": "One", "ubiquitous-language": {"Entities": {"X": {"name": "X", "SYNONYMS_TO_AVOID": "single", "attributes": [{"name": "a1", "type": "t"}, {"type": "t"}, None, "a4"]}, "Y": "Y"}}, "valueObjects": [{"name": "V", "attributes": [1, ""]}]}}}
WANT = sorted([(0, "entity", 0, "attribute", 0, "a1"), (0, "entity", 0, "attribute", 3, "a4"), (0, "entity", 0, "synonym", 0, "single"), (0, "value_object", 0, "attribute", 0, "1")], key=repr)


@pytest.mark.parametrize("wrap", [lambda s: s, lambda s: json.dumps(s), lambda s: f"```json\n{s}\n```", lambda s: f"Here it is:\n{s}\nDone.", lambda s: "﻿" + s, lambda s: '{"timestamp": "t", "final_model": ' + s + "}", lambda s: f"Answer:\n\n```\n{s}\n```\n", lambda s: f"Here is the [draft] model {{x}}: {s}", lambda s: f"[1] The model follows: {s} [2]", lambda s: f"[{{\"model\": {s}}}]"])
def test_payload_shapes(spark, rows, wrap):
    assert found(spark, rows, wrap(json.dumps(BASE))) == WANT


@pytest.mark.parametrize("payload", [None, "", "   ", "no model", "{", json.dumps(BASE)[:-2], "[1, 2", "null", '{"bounded_contexts": null}', '{"bounded_contexts": 5}', "{" * 5000, "{\"model\": " + json.dumps(BASE), "[" + json.dumps(BASE) + ", {", '"' + "x" * 100_000 + '"'])
def test_no_cases(spark, rows, payload):
    assert found(spark, rows, payload) == []


def test_empty_tables(spark, rows):
    t = tables(spark, [], [])
    assert rows(nested.model_leaves(t)) == [] and t["bounded_contexts"].count() == 0


def inferred(spark, values, **bounds):
    found = set()
    for v in values:
        nested._paths(v, "$", found)
    return nested.without_void(nested.infer_json_schema(spark.createDataFrame(sorted(found), "path string, kind string"), **bounds))


def test_merged_schema(spark):
    values = [[{"a": 1, "b": [{"c": None}], "e": {}}], [{"a": "x", "d": 1.5, "b": [{"c": "n"}]}], None]
    assert inferred(spark, values).simpleString() == "array<struct<a:string,b:array<struct<c:string>>,d:double,e:string>>"
    assert inferred(spark, [["n"], [{"name": "m", "x": 1}]]).simpleString() == "array<struct<name:string,x:bigint>>"


def test_names_that_are_data_become_a_map(spark, rows):
    values = [[{"a": 1, "other": {f"k{i}": {"deep": [i]}}}] for i in range(12)]
    assert inferred(spark, values, most_paths=10, most_fields=5).simpleString() == "array<struct<a:bigint,other:map<string,string>>>"
    df = spark.createDataFrame([(1, [(1, {"k": "v", "l": None})])], "id bigint, c array<struct<a:int,other:map<string,string>>>")
    assert rows(nested.flatten(df, "id", "c")["c.other"].select("f_key", "f_value")) == [("k", "v"), ("l", None)]
