import random

from pyspark.sql import functions as F

from sijill.operators import registry as R


def test_numbers_within_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab") if rng.random() < 0.9 else None) for i in rng.sample(range(1000), 200)]
    got = {r.i: r.place for r in R.numbered(spark.createDataFrame(rows, "i long, k string").where("k IS NOT NULL"), "k", "i", 50).collect()}
    for key in "ab":
        own = sorted(i for i, k in rows if k == key)
        assert [got[i] for i in own] == list(range(1, len(own) + 1))


def test_most_shared_finds_every_best_row(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, f"d{i % 7}", sorted(set(rng.choices(words, weights=[1 / (k + 1) for k in range(30)], k=rng.randint(0, 9))))) for i in range(120)]
    df = spark.createDataFrame(rows, "search_id long, document_id string, ws array<string>")
    asked = df.where("search_id % 5 = 0").select(F.col("search_id").alias("query_id"), "ws")
    got = {}
    for r in R.most_shared(asked, df).collect():
        got.setdefault(r.query_id, {})[r.search_id] = r.score
    for q, _, ws in rows[::5]:
        want = {i: len(set(ws) & set(own)) for i, _, own in rows if i != q}
        best = max(want.values())
        if best:
            assert {i for i, s in got[q].items() if s == best} == {i for i, s in want.items() if s == best} and all(want[i] == s for i, s in got[q].items())
