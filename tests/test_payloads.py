import json

from pyspark.sql import functions as F

from sijill.operators import payloads as P
from sijill.operators.nested import TreeAutomaton
from sijill.sources import pipeline as L
from tests.test_dialect import DECISION, both, facts


def test_standard_payload(spark):
    rows = spark.createDataFrame([(1, "f.docx", DECISION), (2, "g.txt", None), (3, None, "")], "record_id long, source_file string, long_text string")
    got = {r.record_id: json.loads(r.payload) for r in P.standard_payloads(rows).collect()}
    one = got[1]
    assert one["schema_version"] == P.VERSION and one["source"] == {"filename": "f.docx", "extension": "docx"}
    assert one["document"]["decision_number"] == "27" and one["metadata"]["recipient"] == "وزارة النفط" and one["signature"]["name"] == "سعاد كريم"
    assert [s["id"] for s in one["decision"]["sections"]] == list(range(1, len(one["decision"]["sections"]) + 1)) and len(one["decision"]["numbered_items"]) == 2
    assert one["extracted_fields"]["percentages"] == ["(10%)"] and set(got) == {1, 2, 3} and got[2]["decision"]["sections"] == []


def test_filled_fields_say_where_they_come_from(spark):
    content = spark.createDataFrame([(1, "a", "", None, " "), (2, "", "", "", "")], "record_id long, legal_references string, responsibilities string, outcome string, affected string")
    replies = spark.createDataFrame([(1, "x", "y", "z", "")], "record_id long, legal_references string, responsibilities string, outcome string, affected string")
    got = {r.record_id: r for r in P.filled(content, replies).collect()}
    assert (got[1].legal_references, got[1].legal_references_source, got[1].outcome, got[1].outcome_source, got[1].affected) == ("a", "rules", "z", "model", None)
    assert got[2].outcome is None and got[2].outcome_source is None


def test_element_errors_against_plain_python(spark, small):
    records = spark.read.parquet(f"{small}/loaded_legal_json.parquet").select("record_id", "payload", "long_text")
    want = {}
    for r in records.collect():
        for kind, _, _, _, _, body in TreeAutomaton().run(r.payload):
            if kind in ("section", "legal_item"):
                x = json.loads(body)
                text = (x if isinstance(x, str) else x.get("text")) or ""
                text = text if isinstance(text, str) else json.dumps(text)
                n = want.setdefault((r.record_id, kind), [0, 0, 0])
                n[0] += 1
                n[1] += not text.strip(" ")
                n[2] += bool(text.strip(" ")) and text not in (r.long_text or "")
    got = {(r.record_id, r.child_table): [r.n_elements, r.n_empty, r.n_missing] for r in P.element_errors(records).collect()}
    assert got == want and got


def test_repair(spark):
    text = "قرار رقم ٥ لسنة 2019"
    once = text.encode().decode("latin-1")
    windows = "".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())
    rows = [(1, once), (2, windows), (3, once.encode().decode("latin-1")), (4, text), (5, "café Ã"), (6, None), (7, ""), (8, "x" * 100_000)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i long, t string").select("i", P.repaired(F.col("t")).alias("t")).collect()}
    assert got[1] == got[2] == got[3] == got[4] == text and got[5] == "café Ã" and got[6] is None and got[7] == "" and len(got[8]) == 100_000


def test_replies_and_counts(spark):
    assert both(spark, P.embedded_json, 'Sure: {"a": {"b": 1}} done') == '{"a": {"b": 1}}' and both(spark, P.embedded_json, "{broken") is None and both(spark, P.embedded_json, None) is None
    m = facts(spark, P.parse_metrics)
    assert (m.n_items, m.valid) == (2, True) and m.n_paragraphs == 15
    assert facts(spark, P.decision_gaps, "").missing == "legal_references responsibilities outcome affected"


def test_pipeline(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.txt").write_text(DECISION, encoding="utf-8")
    (folder / "b.docx").write_bytes(b"broken")
    (folder / "c.exe").write_bytes(b"x")
    status = {r.source_file: r.status for r in L.process(spark, str(folder), target).collect()}
    assert status["a.txt"] == "indexed" and set(status) == {"a.txt", "b.docx"} and status["b.docx"] != "indexed"
    first = spark.read.parquet(f"{target}/index").count()
    assert first > 5 and spark.read.json(f"{target}/documents").count() == 1
    (folder / "d.md").write_text("# عنوان\nأولاً: نص\nتتمة", encoding="utf-8")
    L.process(spark, str(folder), target)
    rows = spark.read.parquet(f"{target}/index")
    assert rows.where("source_file = 'a.txt'").count() == first and rows.where("source_file = 'd.md'").count() == 2
    assert rows.select("chunk_id").distinct().count() == rows.count()
