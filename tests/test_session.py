import types

import pytest

from sijill import session as S


def test_no_local_scratch_on_a_cluster():
    conf = types.SimpleNamespace(get=lambda *a: None)
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", applicationId="a")
    with pytest.raises(ValueError):
        S.scratch_root(types.SimpleNamespace(sparkContext=context, conf=conf))


def test_named_folder_is_used():
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", applicationId="a")
    conf = types.SimpleNamespace(get=lambda *a: "hdfs:///shared/")
    assert S.scratch_root(types.SimpleNamespace(sparkContext=context, conf=conf)) == "hdfs:///shared"


def test_scratch_is_cleared(spark, tmp_path):
    df = S.materialize(spark.range(3), "test")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert S.exists(spark, path) and df.count() == 3
    S.clear_scratch(spark, path)
    assert not S.exists(spark, path)
    S.clear_scratch(spark, str(tmp_path / "never there"))


def test_stored_objects_are_built_once(spark):
    built = []
    make = lambda: built.append(1) or {"a": [1, 2]}
    tag = f"test-{S.uuid.uuid4().hex}"
    assert S.stored(spark, tag, make) == S.stored(spark, tag, make) == {"a": [1, 2]} and built == [1]


def test_spread_deals_small_scans(spark, small):
    rows = S.texts(spark, small, "chunks", "row_id")
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and rows.columns == ["row_id"]
    assert S.spread(spark.range(0, 100, 1, 50)).rdd.getNumPartitions() == 50
