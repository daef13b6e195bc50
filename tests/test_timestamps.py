import pytest

from sijill.operators.timestamps import TimestampDictionary, normalise, normalise_timestamps, p1_found
from sijill.session import scratch_path


@pytest.mark.parametrize(
    "raw, zone, want",
    [
        ("2012-10-28T02:03:15", "UTC", "2012-10-28T02:03:15.000000Z"),
        ("٢٧/١١/٢٠١٦", "Europe/Berlin", "2016-11-27"),
        ("20.08.22", None, "2022-08-20"),
        ("3 تموز 2011", None, "2011-07-03"),
        ("21 تشرين الثاني 2014", None, "2014-11-21"),
        ("الخميس 2/11/2017", None, "2017-11-02"),
        ("7/4/2019 5:11:54 م", None, "2019-04-07T14:11:54.000000Z"),
        ("12/1/2020 12:05:00 ص", "UTC", "2020-01-12T00:05:00.000000Z"),
        ("Oct 25, 2010 3:27:25 PM", "Europe/London", "2010-10-25T14:27:25.000000Z"),
        ("1561821544", None, "2019-06-29T15:19:04.000000Z"),
        ("1506670336859", None, "2017-09-29T07:32:16.859000Z"),
        ("1327328110096679", None, "2012-01-23T14:15:10.096679Z"),
        ("2020-02-23T09:39:50+03:00[Asia/Baghdad]", "UTC", "2020-02-23T06:39:50.000000Z"),
        ("28/11/2011 15:14:20 EST", "UTC", "2011-11-28T20:14:20.000000Z"),
        ("20160731T123339Z", None, "2016-07-31T12:33:39.000000Z"),
        # twice in its zone: the first occurrence; never: no case
        ("2019-10-27 02:30", "Europe/Berlin", "2019-10-27T00:30:00.000000Z"),
        ("2014-03-30 02:22", "Europe/Berlin", None),
        ("30/02/2019", None, None),
        ("2020-06-10 25:10:00", None, None),
        ("5/2020", None, None),
        ("2021", None, None),
        ("بلا تاريخ", None, None),
        ("", None, None),
        (None, None, None),
        ("x" * 100_000, None, None),
    ],
)
def test_normalise(raw, zone, want):
    assert normalise(raw, zone) == want


def test_rows_repeats_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, "1/2/2020", None, "UTC", "a"), (2, "1/2/2020", "2020-01-01 10:00", None, "b"), (2, "1/2/2020", None, None, "c"), (3, None, "", "Nowhere/Else", None)],
        "id long, d1 string, d2 string, zone string, raw string",
    )
    path = scratch_path(spark, "test")
    got = sorted(map(tuple, normalise_timestamps(df, "id", ["d1", "d2"], "zone", TimestampDictionary(spark, path)).collect()))
    assert got == [(1, "d1", "2020-02-01"), (2, "d1", "2020-02-01"), (2, "d1", "2020-02-01"), (2, "d2", "2020-01-01T07:00:00.000000Z")]
    assert normalise_timestamps(df.limit(0), "id", ["d1"], "zone", TimestampDictionary(spark, scratch_path(spark, "test"))).count() == 0


def test_dictionary_only_grows_by_new_pairs(spark):
    dictionary = TimestampDictionary(spark, scratch_path(spark, "test"))
    first = spark.createDataFrame([("1/2/2020", None), ("1/2/2020", None), ("junk", "UTC")], "raw string, zone string")
    assert dictionary.extend(first).count() == 2
    assert dictionary.extend(first.union(spark.createDataFrame([("3/2/2020", "UTC")], "raw string, zone string"))).count() == 3


def test_found(spark, small):
    df = p1_found(spark, small)
    assert df.columns == ["search_id", "field", "normal_form"]
    assert df.count() > 0


def test_pairs_written_twice_count_once(spark):
    dictionary = TimestampDictionary(spark, scratch_path(spark, "test"))
    rows = spark.createDataFrame([(1, "1/2/2020", None), (2, "1/2/2020", "")], "id long, d string, zone string")
    other = spark.createDataFrame([("1/2/2020", None, "2020-02-01")], TimestampDictionary.SCHEMA)
    other.write.parquet(dictionary.path)
    other.write.mode("append").parquet(dictionary.path)
    assert sorted(map(tuple, normalise_timestamps(rows, "id", ["d"], "zone", dictionary).collect())) == [(1, "d", "2020-02-01"), (2, "d", "2020-02-01")]


def test_dictionary_of_the_query_is_kept(spark, small):
    first = p1_found(spark, small).count()
    assert p1_found(spark, small).count() == first
