from pyspark.sql import functions as F

from sijill.functions import arabic as A
from sijill.operators import best as T
from sijill.operators import retrieval as R
from sijill.operators import search as Z


def pairs(*_):
    raise AssertionError("a row for each question and text")


def texts(spark, n=40):
    return spark.createDataFrame([(i, f"قرار النفط رقم {i % 7} لسنة {2000 + i % 3} بشأن الماء {'والسفر' * (i % 2)}") for i in range(n)], "doc_id long, text string")


def asking(spark):
    return spark.createDataFrame([(7, "قرار النفط رقم 3 لسنة 2001"), (8, "السفر والماء"), (9, None), (10, "لا شيء")], "query_id long, text string")


def test_lexical_candidates_without_a_row_for_each_pair(spark, monkeypatch):
    own = Z.asked(asking(spark))
    docs = Z.searched(texts(spark), own)
    every = sorted(map(tuple, Z.lexical_candidates(own, docs, 1000).collect()))
    assert len(every) > 60
    monkeypatch.setattr(R, "scored_postings", pairs)
    monkeypatch.setattr(T, "ROWS", 6)
    monkeypatch.setattr(T, "ASKED", 1)
    for k in (1, 3, 10):
        assert sorted(map(tuple, Z.lexical_candidates(own, docs, k).collect())) == [r for r in every if r[3] <= k]


def test_words_and_hashes_are_those_of_the_other_side(spark, medium):
    rows = spark.read.parquet(f"{medium}/chunks.parquet").select(A.normalize_search(F.col("text")).alias("norm")).union(spark.createDataFrame([("",), ("وال الو 7 70 و ال والا 5/6/2005 ٠",)], "norm string"))
    got = T.with_tokens(rows).select(F.array_sort("tokens").alias("t"), F.array_sort(F.array_distinct(A.search_tokens(F.col("norm"), True))).alias("w"))
    assert got.where("t <> w").count() == 0 and got.count() == rows.count()
    words = [*[r[0] for r in got.select(F.explode("t")).distinct().limit(500).collect()], "", "ا" * 50]
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect():
        assert T.xxhash64(r.w.encode()) == r.h


def test_bm25_without_a_row_for_each_pair(spark, monkeypatch):
    every = sorted(map(tuple, R.bm25(asking(spark), texts(spark), None).collect()))
    assert len(every) > 60
    monkeypatch.setattr(R, "scored_postings", pairs)
    monkeypatch.setattr(T, "ROWS", 6)
    monkeypatch.setattr(T, "ASKED", 1)
    for k in (1, 10):
        assert sorted(map(tuple, R.bm25(asking(spark), texts(spark), k).collect())) == [r for r in every if r[3] <= k]
    assert R.bm25(asking(spark).limit(0), texts(spark)).count() == 0 and R.bm25(asking(spark), texts(spark).limit(0)).count() == 0


def test_near_copies_are_folded_without_lambdas(spark):
    rows = [(7, i, 1 - i / 1000, [f"w{j}" for j in range(60)] + ["x"] * (i % 2)) for i in range(200)] + [(7, 500, 0.1, ["z"]), (7, 501, 0.1, []), (7, 502, 0.1, [])]
    ranked = spark.createDataFrame(rows, "query_id long, doc_id long, score double, tokens array<string>")
    found = R.without_near_copies(ranked, 5)
    assert [(r.doc_id, r.place) for r in found.orderBy("place").collect()] == [(0, 1), (500, 2), (501, 3), (502, 4), (1, 5)]
    assert "lambdafunction" not in found._jdf.queryExecution().toString()


def test_vectors_by_small_batches_are_the_same(spark, monkeypatch):
    df = spark.range(500).selectExpr("id", "transform(sequence(1, 8), i -> cast(pmod(xxhash64(id % 90, i), 5) - 2 as float)) AS e")
    asked = df.where("id % 9 = 0")
    for metric in ("l2", "cosine"):
        want = sorted(map(tuple, R.vector_top_k(asked, df, "id", "e", metric, 500).where("place <= 4").collect()))
        monkeypatch.setattr(R, "VECTORS", 16)
        monkeypatch.setattr(R, "CELLS", 64)
        found = R.vector_top_k(asked, df.coalesce(1), "id", "e", metric, 4)
        assert sorted(map(tuple, found.collect())) == want
        monkeypatch.undo()


def test_sources_of_results_without_a_row_for_each_pair(spark, medium, monkeypatch):
    from sijill.plans import retrieval as P

    monkeypatch.setattr(R, "scored_postings", pairs)
    assert P.result_sources(spark, medium).count() == 70


def test_sources_of_odd_rows_worked_out_once(spark, tmp_path):
    import __spark_entry__ as entry
    from tests.compare import assert_same, duck

    text, titles = "قرار النفط رقم 3 لسنة 2001", ["عنوان", " عنوان ", "\u00a0عنوان\u2003", "\u00a0", "\t", "\u00a0\n", "", None, "\u3000x\u3000", "\u200bx"]
    tables = {
        "chunks": ("row_id bigint, text varchar, chunk_id varchar, document_title varchar, source_file varchar, page_number int", [(i, text + " والماء" * (i % 2), None if i == 3 else f"c{i // 2}", titles[i % 10], "\u00a0f " if i % 3 else None, i if i % 4 else None) for i in range(1, 25)]),
        "search_records": ("search_id bigint, title varchar", [(0, text), (50, None), (100, ""), (150, "الماء"), (200, "لا شيء"), (7, text)]),
        "citation_registry": ("chunk_id varchar, entry_id bigint, legal_reference varchar", [("c1", 1, "مرجع"), ("c1", 2, None), ("c2", 3, None), ("c2", 4, " مرجع 2\u00a0"), ("c4", 6, " "), ("c5", 7, "\u00a0"), (None, 8, "x"), ("c6", 9, "\u00a0ref ")]),
    }
    con = duck(str(tmp_path))
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    found = entry.queries()["result_sources"](spark, str(tmp_path))
    assert_same(found, con, entry.oracle_sql()["result_sources"])
    # no part of the search stands in what is left to run
    assert "Window" not in found._jdf.queryExecution().toString()


def test_every_record_asks_for_its_best_document(spark, tmp_path):
    import __spark_entry__ as entry
    from tests.compare import assert_same, duck

    con = duck(str(tmp_path))
    con.execute(f"COPY (SELECT * FROM (VALUES (1::BIGINT, 'قرار النفط رقم 3 لسنة 2001'), (7, 'السفر والماء'), (50, 'قرار النفط رقم 3 لسنة 2001'), (51, NULL), (99, 'لا شيء'), (101, 'ما الموافقه على عقد الماء')) t(search_id, title)) TO '{tmp_path}/search_records.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT i AS row_id, CASE WHEN i % 9 > 0 THEN 'قرار النفط رقم ' || i % 7 || ' لسنة ' || 2000 + i % 3 || ' بشأن الماء' || CASE i % 2 WHEN 1 THEN ' والسفر' ELSE '' END END AS text, CASE WHEN i % 5 > 0 THEN 'd' || i % 11 END AS document_id FROM range(120) t(i)) TO '{tmp_path}/chunks.parquet' (FORMAT parquet)")
    con = duck(str(tmp_path))
    sql = entry.oracle_sql()["best_document_per_question"]
    found = entry.queries()["best_document_per_question"](spark, str(tmp_path))
    assert {r.query_id for r in found.collect()} >= {1, 7, 50, 101}
    assert_same(found, con, sql)
    assert "% 50" not in sql


def test_sums_in_common_give_what_each_question_gives_alone(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"قرار {'النفط' if i % 3 else 'الماء'} رقم {i % 40} لسنة {2000 + i % 5} بشأن عقد الماء {'والسفر' * (i % 2)}") for i in range(6000)], "doc_id long, text string")
    asking = spark.createDataFrame([(i, f"قرار {'النفط' if i % 2 else 'الماء'} رقم {i} لسنة {2000 + i % 3} {'ما الموافقه على عقد' if i % 4 == 0 else 'بشأن السفر'}") for i in range(24)] + [(90, "قرار النفط رقم 1 لسنة 2001 بشأن السفر")], "query_id long, text string")
    own = Z.asked(asking)
    docs = Z.searched(texts, own)
    together = sorted(map(tuple, Z.lexical_candidates(own, docs, 4).collect()))
    best = sorted(map(tuple, R.bm25(asking, texts, 4).collect()))
    assert len(together) == len(best) == 100
    monkeypatch.setattr(T, "ASKED", 1)
    assert sorted(map(tuple, Z.lexical_candidates(own.where("query_id % 7 = 6"), docs, 4).collect())) == [r for r in together if r[0] % 7 == 6]
    monkeypatch.undo()
    assert best == sorted(map(tuple, R.bm25(asking, texts, None).where("place <= 4").collect()))


def test_every_record_is_searched_for_wave_after_wave(spark, small, monkeypatch):
    from sijill import session
    from sijill.plans import retrieval as P

    every = {r[0] for r in spark.read.parquet(f"{small}/search_records.parquet").select("search_id").collect()}
    whole = sorted(map(tuple, P.hybrid_rerank(spark, small).collect()))
    assert {r[0] for r in whole} == every
    monkeypatch.setattr(Z, "WAVE", 20)
    written = []
    monkeypatch.setattr(session, "scratch_path", lambda s, tag, path=session.scratch_path: written.append(path(s, tag)) or written[-1])
    assert sorted(map(tuple, P.hybrid_rerank(spark, small).collect())) == whole
    left = [p.rpartition("/")[2].partition("-")[0] for p in written if session.exists(spark, p)]
    assert sorted(left) == ["encoded", "encoded", "found", "found", "questions"]


def test_every_record_is_answered(spark, small, monkeypatch):
    from sijill.plans import retrieval as P

    every = sorted(r[0] for r in spark.read.parquet(f"{small}/search_records.parquet").select("search_id").collect())
    rows = sorted(map(tuple, P.grounded_answers(spark, small).collect()))
    assert [r[0] for r in rows] == every
    monkeypatch.setattr(P, "ANSWERED", 20)
    assert sorted(map(tuple, P.grounded_answers(spark, small).collect())) == rows
