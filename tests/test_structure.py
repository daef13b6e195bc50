from pyspark.sql import functions as F

from sijill.functions import extract as X
from sijill.functions.dialect import column
from sijill.operators import structure as S


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first().x


DECISION = "قرار\nالى الوزارات\nاولا\nأولا: الموافقة\nالمادة (5) من القانون\nثانيا: تنفذ\n\nسعاد\nالأمين العام\n5/6/2020"


def test_items_and_sections(spark):
    items = one(spark, DECISION, lambda c: S.numbered_items(S.paragraphs(c)))
    assert [(x.kind, x.number, x.paragraph_index) for x in items] == [("ordinal_item", "أولا", 4), ("article_reference", "5", 5), ("ordinal_item", "ثانيا", 6)]
    assert [tuple(x) for x in one(spark, DECISION, lambda c: S.sections(S.paragraphs(c)))] == [("header", 1, 3), ("decision_body", 4, 6), ("signature", 7, 9)]
    assert one(spark, None, lambda c: S.sections(S.paragraphs(c))) == [] and one(spark, "", lambda c: S.numbered_items(S.paragraphs(c))) == []


def test_clean_document(spark):
    clean = lambda t: one(spark, t, lambda c: column(S.cleaned_text, "t"))
    pages = "\f".join(f"ترويسة\nنص {i} ,\t5 6\nصفحة {i}" for i in range(4))
    assert clean(pages) == "\n".join(f"نص {i}, 5 6" for i in range(4))
    assert clean(None) == "" and clean("a\n\n\n\nb") == "a\n\nb" and clean("1   2 \n 3  4") == "1 2 3 4"
    assert clean("h\nx\fh\ny") == "h\nx\nh\ny"


def test_extraction(spark):
    assert one(spark, "في 5 / 6/2020 و15/6/20201", X.dates) == ["5 / 6/2020"]
    assert one(spark, "بمبلغ 5.000   دينار", X.amounts) == ["5.000 دينار"]
    assert one(spark, "الجلسة الاعتيادية المنعقدة في 3 / 4/2019", X.session_date) == "3/4/2019"
    assert one(spark, "وزارة النفط وشركة النقل.", X.entity_categories).ministries == ["وزارة النفط"]
    assert [one(spark, d, X.valid_date) for d in ("29/2/2020", "٢٩/٢/٢٠٢١", "x", None)] == [True, False, False, None]
    assert tuple(one(spark, "قانون رقم 5 باسم الشعب", lambda c: X.document_type(X.fold_letters(c)))) == ("Law", 0.96)


def test_hash_embeddings(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, []), (4, None)], "id int, t array<string>")
    got = {r.id: r.embedding for r in S.hash_embeddings(df, "id", "t", 16).collect()}
    assert got[1] == got[2] and len(got[1]) == 16 and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and set(got[3]) == set(got[4]) == {0.0}
