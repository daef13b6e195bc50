import random

import numpy as np
import pytest

from sijill.llm import names as N


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_against_brute_force():
    rng = random.Random(2)
    a = ["".join(rng.choice("abcد ") for _ in range(rng.randint(0, 40))) for _ in range(40)]
    i, j = np.repeat(np.arange(40), 40), np.tile(np.arange(40), 40)
    assert N.distances(a, a, i, j).tolist() == [edits(a[x], a[y]) for x, y in zip(i, j)]


def test_long_texts_differ_where_they_differ():
    a = "x" * 70
    pairs = [(a + "0123456789", a + "abcdefghij"), ("y" + a + "012345678", a + "0123456789"), ("é" * 200, "é" * 199 + "z"), ("", a), (a, "x")]
    rng = random.Random(8)
    pairs += [("".join(rng.choice("ابج ") for _ in range(rng.randint(50, 140))), "".join(rng.choice("ابج ") for _ in range(rng.randint(50, 140)))) for _ in range(30)]
    left, right = [x for x, _ in pairs], [y for _, y in pairs]
    k = np.arange(len(pairs))
    assert N.distances(left, right, k, k).tolist() == [edits(x, y) for x, y in pairs] == [N.edit_distance(x, y) for x, y in pairs]


@pytest.mark.parametrize("first, pet", [("سالم", "سلومي"), ("حسين", "حسوني"), ("كريم", "كروم"), ("عبد الستار", "ستوري"), ("زهير", "زهوري"), ("ليلى", "للول"), ("مروان", "مارو"), ("ضياء", "ضيوي"), ("كوثر", "كواثر")])
def test_pet_forms_come_from_a_rule(first, pet):
    assert min(edits(N.fold(pet), f) for f in N.pet_forms(N.fold(first))) <= 1


def test_short_names_are_read_and_linked_exactly(spark):
    assert ("ministry", "نفط", 0) in N.cores("وزارة نفط")
    values = spark.createDataFrame([("وزارة نفط",), ("وزارة نفض",), ("و. النفط",)], "value string")
    parties = spark.createDataFrame([(1, "وزارة النفط", "organisation")], "party_id long, official_name string, kind string")
    assert {r.value for r in N.link_names(values, parties).collect()} == {"وزارة نفط", "و. النفط"}


PARTIES = [
    (1, "وزارة الفروسية والفلك", "organisation"),
    (2, "المديرية العامة للخزن المبرد في وادي القيصوم", "organisation"),
    (3, "شركة برج العنقاء للخدمات النفطية المحدودة", "organisation"),
    (4, "عبد الجبار عزيز رمضان الفرسخوناوي", "person"),
    (5, "قاسم شاكر عزيز الهزبري", "person"),
    (6, "قاسم خضير حميد الريحي", "person"),
    (7, None, "person"),
]


@pytest.mark.parametrize(
    "value, party",
    [
        ("و. الفلك والفروسية", 1), ("وزارة الفلك - الفروسية / مكتب الوزير", 1), ("السادة وزاثة اللفك المحترمون", 1), ("وزارة الفروسية والفلك", 1),
        ("م.ع. الخزن المبرد في وادي القيصوم", 2), ("وادي القيصوم - الخزن المبرد", 2), ("مديرية الخزن المبرد / وادي القيصوم / قسم القانونية", 2), ("المديرية العامة لالخزن المبرد بوادي القيصوم", 2),
        ("ش. برج العنقاء", 3), ("برج العنقاء للخدمات النفطية م.م", 3), ("للخدمات النفطية (شركة برج العنقاء)", 3),
        ("جبوري الفرسخوناوي", 4), ("عبد الجبار ع. ر. افرسخوناوي", 4), ("الفرسخوناوي، عبد الجبار", 4), ("السيد عبد الجبار بن عزيز بن رمضان الفرسخوناوي", 4),
        ("ق. شاكر الهزبري", 5), ("قسومي الريحي", 6),
        ("قاسم منذر الهزبري", None), ("روضة براعم الضحى الأهلية", None), ("x", None), ("س" * 5000, None),
    ],
)
def test_values(linked, value, party):
    assert linked.get(value) == party


@pytest.fixture(scope="module")
def linked(spark):
    values = [v for v, _ in test_values.pytestmark[0].args[1]]
    df = spark.createDataFrame([(v, "x") for v in [*values, *values, None, "  "]], "value string, party_id string")
    parties = spark.createDataFrame(PARTIES, "party_id long, official_name string, kind string")
    return {r.value: r.party_id for r in N.link_names(df, parties).collect()}


def test_join_is_exact(spark):
    """The partitioned join finds every pair within the radius that brute force finds."""
    forms = sorted({f for i, n, k in PARTIES if n for f in N.forms(n, k)})
    registered = spark.createDataFrame([(1, k, f) for k, f in forms], "party_id long, kind string, form string")
    rng = random.Random(4)
    typed = []
    for k, f in rng.sample(forms, 60):
        chars = list(f)
        for _ in range(rng.randint(0, 3)):
            chars[rng.randrange(len(chars))] = rng.choice("ابتثجح")
        typed.append((k, "".join(chars)))
    typed = sorted(set(typed))
    got = {(r.kind, r.core, r.form) for r in N.radius_join(spark.createDataFrame(typed, "kind string, core string"), registered).collect()}
    want = {(k, c, f) for k, c in typed for kk, f in forms if k == kk and edits(c, f) <= N.radius(c)}
    assert got == want


def test_large_cells_are_dealt_over_salts(spark, monkeypatch):
    forms = sorted({f for i, n, k in PARTIES if n for f in N.forms(n, k)})
    registered = spark.createDataFrame([(1, k, f) for k, f in forms], "party_id long, kind string, form string")
    typed = spark.createDataFrame(forms, "kind string, core string")
    want = sorted(map(tuple, N.radius_join(typed, registered).collect()))
    monkeypatch.setattr(N, "SHARE", 3)
    assert sorted(map(tuple, N.radius_join(typed, registered).collect())) == want


def test_empty(spark):
    values = spark.createDataFrame([], "value string")
    parties = spark.createDataFrame(PARTIES, "party_id long, official_name string, kind string")
    assert N.link_names(values, parties).count() == 0
    assert N.link_names(spark.createDataFrame([("a b",)], "value string"), parties.limit(0)).count() == 0


def test_found(spark, small):
    df = N.p4_found(spark, small)
    assert df.columns == ["decision_id", "field", "party_id"] and df.count() > 0
