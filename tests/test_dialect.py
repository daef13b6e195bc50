"""Operators defined once: both engines agree, and say what is expected, on texts that hold what they look for."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from sijill.functions.dialect import DUCK, SPARK
from sijill.operators import answers as N
from sijill.operators import decisions as D
from sijill.operators import law as L
from sijill.operators import lawrecords as W
from sijill.operators import questions as Q
from sijill.operators import records as R

DECISION = """قرار مجلس الوزراء
رقم (27) لسنة 2019
إلى/ وزارة النفط
الموضوع/ تمديد عقد
قرر مجلس الوزراء بجلسته الخامسة عشرة المنعقدة في 3/4/2019 ما يأتي:
أولاً: الموافقة على كتاب وزارة المالية المرقم بالعدد (م/55) المؤرخ في 1/2/2019 بمبلغ (5.000) دينار ونسبة (10%).
ثانياً: تتحمل وزارة النفط التنفيذ خلال (30) يوم بطول (12) كم.
المرافقات
نسخة القرار
سعاد كريم
الأمين العام لمجلس الوزراء
15/4/2019
صورة عنه إلى
مكتب الوزير
ختم 1/1/2019
"""


def both(spark, operator, *values):
    """The operator's value from Spark, after checking that DuckDB's is the same."""
    names = [f"c{i}" for i in range(len(values))]
    kinds = ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'array<string>'}" for n, v in zip(names, values))
    got = spark.createDataFrame([tuple(values)], kinds).select(F.expr(operator(SPARK, *names)).alias("x")).first().x
    rows = duckdb.connect()
    sql = ", ".join(f"CAST(? AS {'VARCHAR' if v is None or isinstance(v, str) else 'VARCHAR[]'}) AS {n}" for n, v in zip(names, values))
    want = rows.execute(f"SELECT {operator(DUCK, *names)} FROM (SELECT {sql})", list(values)).fetchone()[0]
    assert got == want
    return got


@pytest.mark.parametrize(
    "operator, question, want",
    [
        (lambda q, x: Q.matches(q, x, Q.DECISION_NUMBER), "ما هو رقم القرار؟", True),
        (lambda q, x: Q.matches(q, x, Q.RECOMMENDATION_NUMBER), "ما رقم توصية من المجلس الوزاري للاقتصاد", True),
        (lambda q, x: Q.matches(q, x, Q.SOURCE_BOOK), "بناء على اي كتاب صدر", True),
        (lambda q, x: Q.matches(q, x, Q.WHOLE_TEXT), "اعطني النص كاملا", True),
        (lambda q, x: Q.matches(q, x, Q.WHOLE_DOCUMENT), "ما مضمون هذا القرار", True),
        (lambda q, x: Q.needs_several(q, q.norm(x)), "كم عدد القرارات التي صدرت", True),
        (lambda q, x: Q.needs_several(q, q.norm(x)), "متى صدر القرار 5", False),
        (Q.is_follow_up, "ومتى صدر", True),
        (Q.is_follow_up, "ما رقم الطلب", True),
        (Q.is_follow_up, "ما هي عقوبة الغش التجاري", False),
        (Q.is_follow_up, None, False),
        (Q.names_a_law, "قانون رقم (5) لسنة 2010", True),
        (Q.names_a_law, "كم مبلغ قانون رقم 5", False),
        (Q.quick_reply, "  مرحبا!! ", "greeting"),
        (Q.quick_reply, "شكرا", "thanks"),
        (Q.quick_reply, "", "short"),
        (Q.quick_reply, "متى صدر القرار", None),
        (Q.date_field, "متى انعقدت الجلسة", "session_date"),
        (Q.date_field, "تاريخ صدور القرار", "issue_date"),
        (lambda q, x: Q.intents(q, q.norm(x)), "كم سعر الطن ومتى صدر", ["amount", "date"]),
        (lambda q, x: Q.intents(q, q.norm(x)), "بين أي جهتين أُبرم العقد", ["comparison"]),
        (lambda q, x: Q.signals(q, q.norm(x)), "كتاب 12/55 في 3/4/2019 لوزارة النفط", ["3/4/2019", "12/55", "3/4/2019"][:2]),
        (Q.required_markers, "عقد AB-12 في 3/4/2019 بمبلغ 1.000.000", ["AB-12", "3/4/2019", "1.000.000"]),
    ],
)
def test_questions(spark, operator, question, want):
    got = both(spark, operator, question)
    assert got[: len(want)] == want if isinstance(want, list) and question.startswith("كتاب") else got == want


def test_expansion_and_markers(spark):
    text = both(spark, lambda q, x: Q.expansion(q, x, q.norm(x), Q.intents(q, q.norm(x)), Q.signals(q, q.norm(x))), "متى صدر القرار 27؟")
    assert text.split("\n")[0] == "متى صدر القرار 27؟" and Q.EXPANSIONS["date"] in text and "27" in text.split("\n")[-1].split()
    assert both(spark, lambda q, m, c: Q.missing_markers(q, m, c), ["AB-12", "3/4/2019", "ZZ"], "في 3 / 4 / 2019 ab 12") == ["ZZ"]


def facts(spark, statement, text=DECISION):
    """A statement's row for one record, from both engines."""
    rows = [(1, "f_1.docx", text)]
    spark.createDataFrame(rows, "record_id long, source_file string, long_text string").createOrReplaceTempView(SPARK.table("loaded_legal_json"))
    got = spark.sql(statement(SPARK)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE loaded_legal_json (record_id BIGINT, source_file VARCHAR, long_text VARCHAR)")
    con.executemany("INSERT INTO loaded_legal_json VALUES (?, ?, ?)", rows)
    cur = con.execute(statement(DUCK))
    names = [c[0] for c in cur.description]
    assert sorted([r.asDict() for r in got], key=str) == sorted([dict(zip(names, r)) for r in cur.fetchall()], key=str)
    return got[0] if len(got) == 1 else got


def test_decision_metadata(spark):
    r = facts(spark, D.metadata)
    assert (r.document_number, r.document_year, r.issue_date, r.session_number, r.session_date) == ("27", "2019", "15/4/2019", "الخامسة عشرة", "3/4/2019")
    assert (r.subject, r.reference_number, r.sender, r.recipient) == ("تمديد عقد", "م/55", "مجلس الوزراء", "وزارة النفط")
    assert r.signature == "سعاد كريم - الأمين العام لمجلس الوزراء" and r.attachments == "نسخة القرار" and r.distribution == "مكتب الوزير"
    w = facts(spark, D.second_metadata)
    assert (w.title, w.document_type, w.decision_number, w.year, w.issue_date) == ("قرار مجلس الوزراء رقم (27) لسنة 2019", "قرار مجلس الوزراء", "27", "2019", "15/4/2019")
    assert (w.signer_name, w.signer_title, w.reference_references) == ("سعاد كريم", "الأمين العام لمجلس الوزراء", "م/55")
    m = facts(spark, D.metadata, "وزارة النفط / الدائرة القانونية\nنص")
    assert (m.ministry, m.department, m.sender) == ("وزارة النفط", "الدائرة القانونية", "وزارة النفط / الدائرة القانونية")


@pytest.mark.parametrize("text", [None, "", " \n\r\n ", "x" * 50_000])
@pytest.mark.parametrize("statement", [D.metadata, D.second_metadata, D.field_values, D.content, L.law_sections, W.law_records, W.government_records])
def test_edges(spark, statement, text):
    assert facts(spark, statement, text).record_id == 1


def test_decision_values_and_content(spark):
    v = facts(spark, D.field_values)
    assert v.money == "(5.000) دينار" and v.percentages == "(10%)" and v.durations == "(30) يوم" and v.pipe_lengths == "بطول (12) كم" and v.years == "2019"
    c = facts(spark, D.content)
    assert c.outcome.startswith("قرر مجلس الوزراء بجلسته") and c.responsibilities.startswith("ثانياً: تتحمل")
    spans = facts(spark, D.legal_spans)
    assert [(r.label, r.first, r.last) for r in sorted(spans, key=lambda r: r.first)][5:7] == [("item", 6, 6), ("item", 7, 10)]


LAWS = "مقدمة\n1. قانون الاول رقم 5 لسنة 2010\nالأسباب الموجبة: سبب\nأبرز المواد:\nالمادة (1): نص\nالمادة (1): نص\n12. قرار الثاني\nنص"


def test_law_sections(spark):
    first, second = facts(spark, L.law_sections, LAWS)
    assert (first.heading, first.item_number, first.collection) == ("قانون الاول رقم 5 لسنة 2010", 1, L.COLLECTIONS[0])
    assert first.bonus == 100 + 100 + 2 * 30 and first.summary == "1. قانون الاول رقم 5 لسنة 2010\nالأسباب الموجبة: سبب"
    assert first.topics.startswith("هل تريد معرفة مضمون المادة (1)") and (second.heading, second.item_number) == ("قرار الثاني", 12)
    assert both(spark, lambda q, x: L.cleaned(q, x), ["a", "", "", "a", "b"]) == "a\n\nb"
    assert both(spark, lambda q, x: L.number_year(q, x)[0], "قانون ٥ في 2010") == "5" and both(spark, lambda q, x: L.number_year(q, x)[1], "رقم (7) لسنة (2011)") == "2011"
    score = lambda q, t, s: L.section_score(q, t, "'5'", "'2010'", L.plain(q, s), s)
    assert both(spark, score, ["الاول"], "قانون الاول رقم 5 لسنة 2010") == 5 + 140 + 5 and both(spark, score, ["الاول"], "قانون الاول رقم 6 لسنة 2010") == 0


def test_law_records(spark):
    r = facts(spark, W.law_records, "1. قانون الاستثمار رقم (13) لسنة2006 : تمهيد\nالعنوان: قانون الاستثمار\nيهدف الى دعم المستثمر. وغيره.")
    assert (r.title, r.document_type, r.number, r.year, r.id, r.citation) == ("قانون الاستثمار", "law", 13, 2006, "LAW-13-2006", "قانون رقم 13 لسنة 2006")
    assert r.categories == "استثمار | مالية" and "الاستثمار" in r.keywords.split()
    g = facts(spark, W.government_records, "قانون العمل رقم (37) لسنة 2015\nصدر عن مجلس النواب في 5/6/2015 نافذ من 7/8/2015\nالمادة 1\nنص\nالمادة 2\nنص")
    assert (g.document_type, g.document_number, g.year, g.issuing_authority, g.published, g.effective, g.status, g.id, g.n_articles) == ("law", "37", "2015", "مجلس النواب", "5/6/2015", "7/8/2015", "active", "law-37-2015", 2)


def test_answers(spark):
    answer = "الجواب:\nالمدة سنة [المصدر: f.docx، الصفحة: 3] كاملة.\nالمصادر\nf.docx\nAnswer\nتتمة [المصدر: f.docx، الصفحة: 3]"
    assert both(spark, N.body, answer) == "المدة سنة  كاملة.\n\nتتمة"
    assert both(spark, N.citations, answer) == ["f.docx|3"]
    assert both(spark, lambda q, x: N.title_only(q, x), "قانون العمل رقم (5) لسنة 2010.") is True
    assert both(spark, lambda q, x: N.is_routing(q, N.plain(q, x)), "صورة عنه إلى: مكتب") is True and both(spark, lambda q, x: N.is_routing(q, N.plain(q, x)), "صورة عنه إلى قرر مجلس الوزراء") is False
    assert both(spark, lambda q, a, c: N.unsupported_numbers(q, a, c), "5 و ٢١ و 7", "12 و 5") == ["7"]
    assert both(spark, lambda q, a, c: N.unsupported_penalties(q, a, c), "غرامة وسجن", "سجن") == ["غرام"]
    twice = "الأمانة العامة لمجلس الوزراء ، ثم الأمانة العامة لمجلس الوزراء."
    assert both(spark, N.secretariat_once, twice) == "الأمانة العامة لمجلس الوزراء، ثم."
    assert both(spark, N.first_sentence, "- جملة أولى. ثانية.\nالخلاصة:\nx") == "جملة أولى." and both(spark, N.first_sentence, "") == ""
    assert both(spark, N.first_sentence, "س " * 300).endswith("س.")
    ask = lambda q, a: N.direct(q, a, "'27'", "'15/4/2019'", "CAST(NULL AS STRING)" if not q.duck else "NULL", q.s(DECISION.replace("\n", " ")))
    assert both(spark, ask, "ما هو رقم القرار") == "رقم القرار هو 27." and both(spark, ask, "متى صدر القرار") == "تاريخ صدور القرار: 15/4/2019."
    assert both(spark, ask, "متى انعقدت الجلسة").endswith("غير مثبت في النص المستخرج من الوثيقة.") and both(spark, ask, "ما رقم كتاب الوزارة") == "رقم كتاب وزارة المالية: م/55." and both(spark, ask, "كلام") is None


def test_records(spark):
    assert both(spark, R.without_summaries, "نص\nالخلاصة: x\nSummary y\n\n\n\nآخر ") == "نص\n\nآخر"
    assert both(spark, R.source_label, "uploaded_0123456789abcdef_my_file.docx") == "my file.docx" and both(spark, R.source_label, " Missing ") == ""
    assert both(spark, R.split_values, "a | b\nb |c") == ["a", "b", "c"]
    wrapped = json.dumps({"document": {"type": "x"}})
    for payload in (wrapped, "﻿" + wrapped, json.dumps(wrapped), json.dumps(json.dumps(wrapped))):
        assert json.loads(both(spark, lambda q, x: q.payload(x), payload)) == {"document": {"type": "x"}}
    for payload in (None, "", "[1]", "{", '"text"', wrapped[:-1]):
        assert both(spark, lambda q, x: q.payload(x), payload) is None


def test_layouts(spark):
    shown = both(spark, lambda q, a, s: N.concise(q, a, s), "الجواب\nنص", ["أ", "ب"])
    assert shown == "Analysis / Relevant Legal Sources\n\nأ\nب\n\nAnswer\n\nنص"
    assert "لا توجد مصادر مطابقة" in both(spark, lambda q, a, s: N.concise(q, a, s), "نص", [])
    assert both(spark, lambda q, a, t: N.appended(q, a, t), "جملة. أخرى", ["س"]) == f"جملة. أخرى\n\n{N.SUMMARY_HEADING}\nجملة.\n\n{N.TOPICS_HEADING}\n- س"
    assert both(spark, lambda q, a, t: N.appended(q, a, t), "", ["س"]) == ""
    assert both(spark, N.indexes, "3, 4,4") == [3, 4]
    assert both(spark, lambda q, f, t: N.match_values(q, [f], [t]), "dir/a.b.docx", "عنوان") == ["dir/a.b.docx", "a.b", "عنوان"]


@pytest.mark.parametrize("payload", [{"metadata": {"document_type": "unknown"}}, {"legal_content": {"articles": []}, "cleaned_text": "x"}, {"legal_structure": {"sections": [{"name": "a"}]}, "title": "t", "original_text": "o"}])
def test_profiles(spark, payload):
    rows = [(1, "f", json.dumps(payload), "x")]
    spark.createDataFrame(rows, "record_id long, source_file string, payload string, long_text string").createOrReplaceTempView(SPARK.table("loaded_legal_json"))
    con = duckdb.connect()
    con.execute("CREATE TABLE loaded_legal_json (record_id BIGINT, source_file VARCHAR, payload VARCHAR, long_text VARCHAR)")
    con.executemany("INSERT INTO loaded_legal_json VALUES (?, ?, ?, ?)", rows)
    got = spark.sql(R.profile_errors(SPARK)).first()
    assert tuple(got) == con.execute(R.profile_errors(DUCK)).fetchone()
    assert ("document_type could not be detected" in got.government) == ("metadata" in payload) and ("legal_structure sections are missing" in got.unified) == ("legal_structure" not in payload)


def test_previews(spark):
    r = facts(spark, R.previews, "1. a < b\n3. c\n2. d")
    assert (r.n_numbered, r.rising) == (3, False)
