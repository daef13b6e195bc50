import math

from pyspark.sql import functions as F

from sijill.functions import arabic as A
from sijill.functions.dialect import SPARK
from sijill.operators import questions as Q
from sijill.operators import registry as G
from sijill.operators import retrieval as R
from sijill.operators import search as Z


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first().x


def test_normalize_and_tokens(spark):
    assert one(spark, "قَــرار رقم (١٣) لسنة ۲۰۰٥، الأُولى", A.normalize_search) == "قرار رقم 13 لسنة 2005، الاولي"
    assert one(spark, "والقرار رقم 13 في 5", A.search_tokens) == ["القرار", "قرار", "والقرار", "رقم", "13", "31", "5"]
    assert one(spark, None, A.normalize_search) == "" and one(spark, "", A.search_tokens) == []


def test_bm25_against_the_formula(spark):
    docs = [(1, "قرار النفط النفط"), (2, "قرار الماء"), (3, "كتاب"), (4, ""), (5, None)]
    got = {r.doc_id: r.score for r in R.bm25(spark.createDataFrame([(9, "النفط قرار")], "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), None).collect()}
    tokens = {1: ["قرار", *["النفط", "نفط"] * 2], 2: ["قرار", "الماء", "ماء"], 3: ["كتاب"], 4: [], 5: []}
    avg = sum(map(len, tokens.values())) / 5
    raw = {}
    for i, t in tokens.items():
        for q in ["النفط", "نفط", "قرار"]:
            if tf := t.count(q):
                df = sum(q in x for x in tokens.values())
                raw[i] = raw.get(i, 0) + math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
    assert got == {i: round(s / max(raw.values()), 6) for i, s in raw.items()}


def test_signals(spark):
    got = one(spark, "قرار مجلس الوزراء رقم 13 في 5/6/2005", lambda c: F.expr(Q.signals(SPARK, SPARK.norm("t"))))
    assert got[:1] == ["5/6/2005"] and "13" in got and "مجلس الوزراء" in got and "2005" in got and "رقم 13 31 5/6/2005" in got


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, meta string, section string, document_key string")


def test_search_drops_near_copies_last(spark):
    text = "قرار منح الاجازة رقم 13 لسنة 2005"
    rows = chunk_rows(spark, [(1, text, "", None, "a"), (2, text + " ", "", None, "a"), (3, "كتاب عن الاجازة والسفر والماء", "", None, "b"), (4, None, "", None, "c"), (5, "", None, None, "d")])
    q = spark.createDataFrame([(7, "قرار الاجازة رقم 13"), (8, None), (9, "")], "query_id long, text string")
    got = [(r.query_id, r.doc_id) for r in Z.search(q, rows, 2).orderBy("query_id", "place").collect()]
    assert [d for i, d in got if i == 7] == [1, 3]
    assert [r.doc_id for r in Z.search(q.where("query_id = 7"), rows, 3).orderBy("place").collect()][:3] == [1, 3, 2]
    assert Z.search(q.limit(0), rows).count() == 0 and Z.search(q, rows.limit(0)).count() == 0


def test_several_documents_give_one_row_each(spark):
    rows = chunk_rows(spark, [(i, f"القرارات التي صدرت بشأن النفط {i}", "", None, "a" if i < 3 else "b") for i in range(5)])
    q = spark.createDataFrame([(7, "ما القرارات التي صدرت بشأن النفط 4")], "query_id long, text string")
    got = Z.search(q, rows).collect()
    assert len(got) == 2 and {r.doc_id for r in got} & {3, 4} and {r.doc_id for r in got} & {0, 1, 2}


def test_weak_sections_are_put_back(spark):
    rows = chunk_rows(spark, [(1, "رقم العقد 55", "", "header", "a"), (2, "رقم العقد 55 .", "", None, "b")])
    q = spark.createDataFrame([(7, "رقم عقد 55")], "query_id long, text string")
    scores = {r.doc_id: r.score for r in Z.search(q, rows, 2).collect()}
    assert abs(scores[2] - scores[1] - Z.PENALTY) < 0.02


def test_metadata_names_rows_that_the_text_does_not(spark):
    rows = chunk_rows(spark, [(1, "نص لا يذكر شيئا", "قرار رقم 977 لسنة 2011", None, "a"), (2, "نص اخر تماما", "", None, "b")])
    q = spark.createDataFrame([(7, "ما مضمون القرار رقم 977")], "query_id long, text string")
    assert Z.search(q, rows, 1).first().doc_id == 1


def test_frequent_terms_are_dealt(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"قرار النفط {i % 3}") for i in range(20)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "قرار النفط 1")], "query_id long, text string")
    want = sorted(map(tuple, R.bm25(q, docs, None).collect()))
    monkeypatch.setattr(R, "POSTINGS", 3)
    assert sorted(map(tuple, R.bm25(q, docs, None).collect())) == want


def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "id long, e array<float>")
    got = [(r.vec_id, r.distance) for r in R.vector_top_k(v.where("id = 1"), v, "id", "e", "cosine", 3).orderBy("place").collect()]
    assert got == [(1, 0.0), (5, 0.0), (2, 1.0)]
    assert R.vector_top_k(v.limit(0), v, "id", "e").count() == 0


def test_upsert_and_last(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, G.upsert(now, new, ["k"]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, G.last_per_key(now.union(new), ["k"], [F.col("v")]).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [r.unique_id for r in G.unique_ids(spark.createDataFrame([("a", 1), ("a", 2)], "k string, o int"), "k", "o").orderBy("o").collect()] == ["a", "a-dup-1"]


def test_fallback_reads_whole_documents(spark):
    docs = spark.createDataFrame([(1, "تمديد العقد رقم 27"), (2, "تمديد المهلة"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "تمديد العقد 27 سنتين"), (8, None), (9, "لا شيء هنا")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in Z.full_text_fallback(q, docs).collect()}
    assert got == {(7, 1): round(2 / 3, 6), (7, 2): round(1 / 3, 6)}


def test_sources_are_named_by_the_registry_first(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, place int")
    chunks = spark.createDataFrame([(10, "a", "title", "f", 3), (11, None, " ", "f", None)], "doc_id long, chunk_id string, document_title string, source_file string, page_number int")
    entries = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("z", 3, "x")], "chunk_id string, entry_id long, legal_reference string")
    assert sorted((r.place, r.label, r.registered) for r in Z.sources(found, chunks, entries).collect()) == [(1, "new", True), (2, "f", False)]
