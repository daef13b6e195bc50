import json

import pytest

from sijill.operators.nested import SUBTYPES, TreeAutomaton, _parsed_deep, child_rows, dumped, nested_rows, p3_found, p3_subtypes, subtype_table, variant_table


def paths(payload):
    return [(r[0], r[1], r[2]) for r in sorted(TreeAutomaton().run(payload))]


def test_paths_and_parents():
    payload = {
        "decision": {"sections": [None, {"title": "a", "subsections": {"title": "b", "references": "text"}}], "numbered_items": json.dumps([{"sub_items": [{"text": "x"}]}])},
        "references": [None, "r", {"type": "law", "references": ["not searched"]}],
        "legal_entities": {"persons": ["p", None, {"name": "q"}], "all": json.dumps(["z"])},
        "other": {"sections": ["not searched"]},
    }
    assert paths(json.dumps(payload)) == [
        ("entity", "legal_entities.all[0]", ""),
        ("entity", "legal_entities.persons[0]", ""),
        ("entity", "legal_entities.persons[2]", ""),
        ("legal_item", "decision.numbered_items[0]", ""),
        ("legal_item", "decision.numbered_items[0].sub_items[0]", "decision.numbered_items[0]"),
        ("reference", "decision.sections[1].subsections[0].references[0]", "decision.sections[1].subsections[0]"),
        ("reference", "references[1]", ""),
        ("reference", "references[2]", ""),
        ("section", "decision.sections[1]", ""),
        ("section", "decision.sections[1].subsections[0]", "decision.sections[1]"),
    ]


@pytest.mark.parametrize("payload", [None, "", "{", '{"sections": [{"a": 1}', "[]", "3", "null", '"text"'])
def test_nothing_from_absent_or_broken(payload):
    assert paths(payload) == []


def test_wrapped_payload_and_mark():
    inner = json.dumps({"entities": [{"name": "a"}]})
    assert paths("﻿" + inner) == paths(json.dumps(inner)) == [("entity", "entities[0]", "")]


def test_deep_nesting():
    node = {"text": "leaf"}
    for _ in range(300):
        node = {"subsections": [node]}
    assert len(paths(json.dumps({"sections": [node]}))) == 301


def test_tables(spark):
    df = spark.createDataFrame(
        [(1, json.dumps({"sections": [{"title": "t", "paragraph_indexes": [1, 2]}], "references": ["r"]}), "x"), (1, json.dumps({"sections": [{"title": "t", "paragraph_indexes": [1, 2]}], "references": ["r"]}), "x"), (2, None, "y")],
        "id long, payload string, path string",
    )
    rows = nested_rows(df, "id", "payload")
    assert rows.count() == 4
    assert {(r.title, tuple(r.paragraph_indexes)) for r in subtype_table(rows, "section_placed").collect()} == {("t", (1, 2))}
    assert [r.text for r in subtype_table(rows, "reference_plain").collect()] == ["r", "r"]
    assert [r.text for r in child_rows(rows, "reference").collect()] == ["r", "r"] and subtype_table(rows, "reference_typed").count() == 0
    assert {(r.variant, r.n_rows) for r in variant_table(rows).collect()} == {("{paragraph_indexes:[n],title:s}", 2), ("s", 2)}
    assert nested_rows(df.limit(0), "id", "payload").count() == 0


def test_found(spark, small):
    assert p3_found(spark, small).columns == ["record_id", "child_table", "path", "parent_path"]


@pytest.mark.parametrize("levels", [1_100, 20_000])
def test_any_depth(levels):
    deep = '{"subsections":[' * levels + '{"text":"leaf"}' + "]}" * levels
    rows = TreeAutomaton().run('{"sections":[' + deep + "]}")
    assert len(rows) == levels + 1 and all(r[4] for r in rows) and sum(len(r[5]) for r in rows) < 100 * levels
    other = TreeAutomaton().run('{"references":[{"target":' + "[" * levels + "]" * levels + "}]}")
    assert other[0][3] == "reference_targeted" and other[0][5] == '{"target": ' + "[" * levels + "]" * levels + "}"


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, null, "x\\u0041\\n"], "b": {}, "c": []}', " [ ] ", '"s"', "3", "[[],[{}]]", "NaN"])
def test_deep_parser_reads_as_json_does(text):
    assert repr(_parsed_deep(text)) == repr(json.loads(text)) and dumped(_parsed_deep(text)) == json.dumps(json.loads(text), ensure_ascii=False)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a":1,}', '{"a" 1}', "[1 2]", "{} {}", "01", "{,}", "[,1]", "nul", '{"a":}'])
def test_deep_parser_refuses_what_json_does(text):
    with pytest.raises(ValueError):
        json.loads(text)
    with pytest.raises(ValueError):
        _parsed_deep(text)


def test_subtypes_add_up(spark, small):
    counts = {(r.child_table, r.subtype): r.n_rows for r in p3_subtypes(spark, small).collect()}
    assert sum(counts.values()) == p3_found(spark, small).count()
    assert set(counts) <= {(t, name) for t, options in SUBTYPES.items() for name, _, _ in options}
