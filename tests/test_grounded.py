import numpy as np
from pyspark.sql import functions as F

from sijill.operators import answers as N
from sijill.operators import grounded as G
from sijill.sources.collections import Collection, read_questions, write_answers

ROWS = [(1, 1, 0.9, "قرر المجلس تمديد العقد لمدة سنتين\nسطر قصير\nمبلغ العقد 500 دينار فقط", "قرار التمديد", "a"), (1, 2, 0.4, "نص اخر عن الماء والكهرباء", "اخر", "b"), (2, 1, 0.8, "نص القرار", "قرار", "a")]


def frames(spark):
    questions = spark.createDataFrame([(1, "ما مدة تمديد العقد"), (2, "ما هو رقم القرار"), (3, "سؤال بلا نتائج"), (4, None)], "query_id long, text string")
    results = spark.createDataFrame(ROWS, "query_id long, place int, score double, text string, title string, document_key string")
    facts = spark.createDataFrame([("a", "27", None, None, "نص كامل"), ("c", "1", None, None, None)], "document_key string, decision_number string, issue_date string, session_date string, long_text string")
    return questions, results, facts


def test_cascade(spark):
    got = {r.query_id: r for r in G.answered(*frames(spark)).collect()}
    assert got[1].kind == "extractive" and "قرر المجلس تمديد العقد" in got[1].answer.split("\n")[0] and got[1].confidence == 0.9 and got[1].n_sources == 2
    assert (got[2].kind, got[2].answer, got[2].confidence) == ("direct", "رقم القرار هو 27.", 1.0)
    assert {got[i].kind for i in (3, 4)} == {"none"} and got[3].confidence == 0.0 and got[3].answer == N.INSUFFICIENT[0]
    assert got[1].sources == "قرار التمديد | اخر" and got[3].topics == ""


def test_model_hook_and_its_refusal(spark):
    answer = lambda qs, cs: ["سنتان." if "مدة" in q else N.INSUFFICIENT[0] for q in qs]
    got = {r.query_id: (r.kind, r.answer) for r in G.answered(*frames(spark), generate=answer).collect()}
    assert got[1] == ("generated", "سنتان.") and got[2][0] == "direct"
    refuse = lambda qs, cs: [N.INSUFFICIENT[0] for _ in qs]
    assert {r.query_id: r.kind for r in G.answered(*frames(spark), generate=refuse).collect()}[1] == "extractive"


def test_embedding_hook(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, " "), (4, "abc")], "id long, t string")
    got = {r.id: r.embedding for r in G.model_embeddings(df, "id", "t", lambda ts: np.array([[len(t), 1.0] for t in ts]), 1).collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: None, 4: [3.0, 1.0]}


def test_filters(spark):
    rows = spark.createDataFrame([(1, 1, "a", "f", "ما هو هذا القرار", False), (1, 2, "b", "g", "ما هو هذا القرار", False), (2, 1, "a", "f", "كم قرارا", True), (2, 2, "b", "g", "كم قرارا", True)], "query_id long, place int, document_key string, source_file string, question string, several boolean")
    assert sorted((r.query_id, r.document_key) for r in G.top_document(rows).collect()) == [(1, "a"), (2, "a"), (2, "b")]
    hints = spark.createDataFrame([(1, "g"), (2, "g"), (2, "zz")], "query_id long, source string")
    assert sorted((r.query_id, r.document_key) for r in G.by_source_hint(rows, hints).collect()) == [(1, "b"), (2, "a"), (2, "b")]


def test_collection(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c")).create()
    assert c.create().stats().first().n_chunks == 0
    make = lambda rows: spark.createDataFrame(rows, "chunk_id string, text string, source_file string, document_title string, document_type string")
    c.upsert(make([("1", "a", "f", "Title One", "Law"), ("2", "b", "f", "Two", "Order"), ("2", "c", "f", "Two", "Order"), (None, "x", "f", None, None)]))
    c.upsert(make([("2", "d", "g", "Two", "Order"), ("3", "e", "g", None, None)]))
    assert sorted((r.chunk_id, r.text) for r in c.read().collect()) == [("1", "a"), ("2", "d"), ("3", "e")]
    assert c.get("2").first().text == "d" and c.find(title="title").first().chunk_id == "1" and c.find(document_type="ORDER").count() == 1 and c.find(source_file="g").count() == 2
    assert sorted((r.source_file, r.n_chunks) for r in c.documents().collect()) == [("f", 1), ("g", 2)]
    c.export(str(tmp_path / "e"))
    c.delete(spark.createDataFrame([("1",)], "chunk_id string"))
    assert c.delete_source("g") == 2 and c.delete_source("g") == 0 and c.stats().first().n_chunks == 0
    c.import_(str(tmp_path / "e"))
    assert c.stats().first().n_chunks == 3
    c.clear()
    assert c.read().count() == 0
    c.drop()
    assert not (tmp_path / "c").exists()


def test_question_batch(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\nسؤال أول\n\n سؤال ثان \n", encoding="utf-8")
    rows = read_questions(spark, str(tmp_path / "q.txt"))
    assert [r.text for r in rows.orderBy("query_id").collect()] == ["سؤال أول", "سؤال ثان"]
    write_answers(rows.withColumn("answer", F.lit("x")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
