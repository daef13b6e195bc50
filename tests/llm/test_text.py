import hashlib

import pytest

from sijill.llm import lookalikes as L
from sijill.llm import mojibake as M

CLEAN = "قرار إداري رقم 12 لسنة 2020 بشأن موقع الطمر الصحي لشركة Brückwald"


def garble(text, true, read):
    return "".join(M._chars_of(read)[b] for b in text.encode(true))


@pytest.mark.parametrize("pair", M.PAIRS)
def test_round_trip_of_each_pair(pair):
    text = CLEAN if pair[0] == "utf-8" else CLEAN.replace("Brückwald", "Durmont")
    whole = garble(text, *pair)
    part = text[:12] + garble(text[12:30], *pair) + text[30:]
    assert M.restore_all([whole, part, text]) == [(True, text), (True, text), (False, text)]


def test_twice_garbled_and_quotes():
    twice = garble(garble(CLEAN, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert M.restore_all([twice, "رقم â€¦ 5"]) == [(True, CLEAN), (True, "رقم … 5")]


def test_lost_bytes_and_clean_texts():
    broken = garble(CLEAN, "utf-8", "cp1252").replace("§", "?", 2)
    assert M.restore_all([broken]) == [(True, None)]
    clean = ["", "SÃO VELMO", "Ångmark Õlmsi Ñurvo", "عقد\xa0Ñurvo – “نص”…", "شروط؛ خط، حفظ؟", "x" * 50_000, "Лугжин Παλμέντ"]
    assert M.restore_all(clean) == [(False, t) for t in clean]


def test_garbled_values(spark):
    df = spark.createDataFrame([(1, garble(CLEAN, "utf-8", "mac_roman"), "a"), (1, garble(CLEAN, "utf-8", "mac_roman"), "a"), (2, CLEAN, "b"), (3, None, None), (4, "", "")], "id long, t string, row_key string")
    assert [tuple(r) for r in M.garbled_values(df, "id", "t", "x").collect()] == [("x", "t", 1, CLEAN)] * 2
    assert M.garbled_values(df.limit(0), "id", "t", "x").count() == 0


def test_p5_found_digest(spark, small):
    rows = M.p5_restored(spark, small).collect()
    want = {(r.table_name, r.row_key): hashlib.md5(r.restored.encode()).hexdigest() if r.restored is not None else "" for r in rows}
    assert {(r.table_name, r.row_key): r.restored_md5 for r in M.p5_found(spark, small).collect()} == want and want


def rewriter():
    return L.Rewriter({c: 10 for c in "ABCEKMOTX0123456789 -/كيىهلام"})


@pytest.mark.parametrize(
    "a, b",
    [("MOB-EX 5", "МОВ‑ЕХ 5"), ("ق/25", "ق∕２５"), ("عالية", "عالیة"), ("كتاب", "کتاب"), ("إلى", "إلی"), ("أمر", "أمر"), ("الأمر", "ﺍﻷﻣﺮ"), ("a b", "a b"), ("ab", "a​b‏"), ("٢٣", "۲۳"), ("é", "é")],
)
def test_read_alike(a, b):
    assert rewriter()(a) == rewriter()(b)


@pytest.mark.parametrize("a, b", [("سنة", "سنه"), ("عملاً", "عملا"), ("إدارة", "ادارة"), ("كتاب", "كتـاب"), ("٤", "۴"), ("5", "٥"), ("علي", "على"), ("٠", "0"), ("كل", "گل"), ("O", "0")])
def test_read_differently(a, b):
    assert rewriter()(a) != rewriter()(b)


def test_union_find_is_transitive():
    uf = L.UnionFind()
    for a, b in [("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")]:
        uf.union(a, b)
    assert sorted(map(tuple, uf.classes())) == [("a", "b", "c", "d"), ("x", "y")]


def test_pairs_copies_nulls_and_garbled(spark):
    bad = garble("نص", "utf-8", "cp1252")
    df = spark.createDataFrame([(1, "A 1", ""), (2, "A 1", ""), (3, "А 1", ""), (4, None, ""), (5, "", ""), (6, bad, ""), (7, bad + "​", ""), (8, "B", "")], "id long, t string, form string")
    assert sorted(map(tuple, L.look_alike_pairs(L.reading_forms(df, "id", "t")).collect())) == [(1, 3), (2, 3)]
    assert L.look_alike_pairs(L.reading_forms(df.limit(0), "id", "t")).count() == 0


def test_every_pair_of_many_copies_is_listed_and_counted(spark):
    df = spark.createDataFrame([(i, "A 1") for i in range(1, 6)] + [(i, "А 1") for i in range(6, 9)], "id long, t string")
    forms = L.reading_forms(df, "id", "t")
    assert sorted(map(tuple, L.look_alike_pairs(forms).collect())) == [(a, b) for a in range(1, 6) for b in range(6, 9)]
    assert {(r.n_rows, r.n_texts) for r in L.look_alike_links(forms).collect()} == {(8, 2)} and L.look_alike_links(forms).count() == 8


def test_garbled_many_times():
    text = bad = "قرار مجلس الوزراء رقم ١٢"
    for _ in range(6):
        bad = garble(bad, "utf-8", "latin-1")
    assert M.restore_all([bad]) == [(True, text)]


def test_p2_against_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/search_records.parquet").select("search_id", "title").where("title is not null").collect()
    counts = L.class_counts(spark.read.parquet(f"{small}/search_records.parquet"), "title")
    form = L.Rewriter(counts)
    garbled = {r.search_id for r, (g, _) in zip(rows, M.restore_all([r.title for r in rows])) if g}
    forms = {r.search_id: form(r.title.replace("\r", "")) for r in rows if r.search_id not in garbled}
    text = {r.search_id: r.title for r in rows}
    want = sorted((a, b) for a in forms for b in forms if a < b and forms[a] == forms[b] and text[a] != text[b])
    got = sorted((r.key_a, r.key_b) for r in L.p2_found(spark, small).where("field = 'title'").collect())
    assert got == want
