from datetime import datetime as D

from pyspark.sql import functions as F

from sijill.operators import orphans as O
from tests.compare import assert_same, duck


def tagged(spark, ps, cs):
    p = spark.createDataFrame(ps, "k string, at timestamp, gone boolean, id long, key string")
    c = spark.createDataFrame(cs, "id long, k string, at timestamp")
    return O.parents(p, "p", O.plain_key(F.col("k")), F.col("at"), F.col("gone"), F.col("id")).unionByName(O.children(c, "p", "c", F.col("id"), O.plain_key(F.col("k")), F.col("at")))


def test_kinds(spark):
    day = lambda d, h=0: D(2021, 1, d, h)
    ps = [(" A ", day(2), False, 1, ""), ("a", day(4), True, 2, ""), ("a", day(6), None, 3, ""), ("b", day(5, 3), False, 4, ""), ("u", None, False, 5, ""), ("t", day(3), False, 6, ""), ("t", day(3), True, 7, "")]
    cs = [
        (1, "A\t", day(1)), (2, "a", day(3)), (3, "a", day(5)), (4, "a", day(6)), (5, "b", day(5, 2)), (6, "b", day(5, 4)), (7, "x", day(1)), (7, "x", day(1)),
        (8, None, day(1)), (9, "a", None), (10, "u", day(1)), (11, "t", day(3)), (12, "x", None),
    ]
    got = sorted((r.row_key, r.kind) for r in O.orphans(tagged(spark, ps, cs)).collect())
    assert got == [(1, "late"), (3, "deleted"), (5, "late"), (7, "missing"), (7, "missing"), (11, "deleted"), (12, "missing")]


def test_empty_tables(spark):
    assert O.orphans(tagged(spark, [], [])).count() == 0
    assert O.orphans(tagged(spark, [], [(1, "a", D(2021, 1, 1))])).first().kind == "missing"


def test_counts_with_clashing_columns(spark):
    heads = spark.createDataFrame([(1, 2, "x"), (2, 0, "x"), (3, None, "x"), (4, 5, "x")], "id long, n long, _n string")
    entries = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (4, None)], "h long, k string")
    assert [r.id for r in O.count_mismatches(heads, "id", "n", entries, "h", F.col("k")).collect()] == [4]


def test_against_sql(spark, medium):
    assert_same(O.p6_found(spark, medium), duck(medium), O.P6_SQL)
