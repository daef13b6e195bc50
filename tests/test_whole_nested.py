"""The typed tables of legal items and references against the payloads read in plain Python."""

import json

import __spark_entry__ as entry
from sijill.operators.nested import TreeAutomaton
from tests.compare import duck


def test_legal_items_and_references(spark, small):
    items, references = [], []
    for key, payload in duck(small).execute("SELECT record_id, payload FROM loaded_legal_json").fetchall():
        for kind, path, _, _, _, body in TreeAutomaton().run(payload):
            x = json.loads(body)
            x = x if isinstance(x, dict) else {"text": x}
            if kind == "legal_item":
                items.append((key, path, x.get("kind"), x.get("number"), x.get("paragraph_index"), x.get("text")))
            elif kind == "reference":
                references.append((key, path, x.get("type"), x.get("text"), x.get("target")))
    assert items and any(r[4] for r in references)
    got = entry.queries()["p3_legal_items"](spark, small).collect()
    assert sorted(((r.record_id, r.path, r.kind, r.number, r.paragraph_index, r.text) for r in got), key=repr) == sorted(items, key=repr)
    got = entry.queries()["p3_references"](spark, small).collect()
    assert sorted(((r.record_id, r.path, r.type, r.text, r.target and json.loads(r.target)) for r in got), key=repr) == sorted(references, key=repr)
