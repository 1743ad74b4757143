"""Assembler null handling, category indexing edges, splits and filters."""

import datetime as dt

import pytest

from kilowatt.functions.vectors import to_array
from kilowatt.operators import features, relational, splits


def test_assemble_invalid_modes(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double")
    with pytest.raises(Exception):
        features.assemble(df, ["a", "b"], invalid="error").collect()
    assert features.assemble(df, ["a", "b"], invalid="skip").count() == 1
    kept = features.assemble(df, ["a", "b"], invalid="keep").select(to_array("features").alias("x")).collect()
    assert len(kept) == 2


def test_index_categories_codes(spark):
    # slot 0: -1, 0, 5 (zero takes code 0); slot 1: constant; slot 2: 4 values;
    # slot 3: 5 values (continuous under max 4).
    rows = [(-1.0, 7.0, 10.0, 1.0), (0.0, 7.0, 20.0, 2.0), (5.0, 7.0, 30.0, 3.0),
            (5.0, 7.0, 40.0, 4.0), (0.0, 7.0, 10.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    vec = features.assemble(df, ["a", "b", "c", "d"])
    model = features.index_categories(vec, "features", "idx", max_categories=4)
    maps = {int(k): {float(v): int(c) for v, c in m.items()} for k, m in model.categoryMaps.items()}
    assert maps[0] == {0.0: 0, -1.0: 1, 5.0: 2}
    assert maps[1] == {7.0: 0}
    assert maps[2] == {10.0: 0, 20.0: 1, 30.0: 2, 40.0: 3}
    assert 3 not in maps
    table = {(r["slot"], r["value"]): r["code"] for r in features.category_maps(model).collect()}
    assert table[(0, -1.0)] == 1


def test_random_split_disjoint_complete_repeatable(spark):
    df = spark.range(0, 5000).repartition(4, "id")
    a = splits.with_random_split(df, [0.7, 0.3], 11, "id", ["train", "test"])
    counts = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert sum(counts.values()) == 5000
    assert 0.65 < counts["train"] / 5000 < 0.75
    b = splits.with_random_split(df, [0.7, 0.3], 11, "id", ["train", "test"])
    assert a.exceptAll(b).count() == 0
    elsewhere = splits.with_random_split(df.repartition(9), [0.7, 0.3], 11, "id", ["train", "test"])
    assert a.exceptAll(elsewhere).count() == 0
    parts = splits.random_split(df, [7, 3], seed=5, key="id")
    ids = [set(r["id"] for r in p.collect()) for p in parts]
    assert not (ids[0] & ids[1]) and len(ids[0] | ids[1]) == 5000
    with pytest.raises(ValueError):
        splits.random_split(df, [0.5, 0.5], seed=None, key="id")


def test_time_split_bounds(spark):
    t0, t1 = "2024-01-22 00:00:00", "2024-01-31 00:00:00"
    times = [dt.datetime(2024, 1, 21, 23, 59, 59), dt.datetime(2024, 1, 22), dt.datetime(2024, 1, 30, 23),
             dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, ts timestamp_ntz")
    train, test = splits.time_split(df, "ts", t0, t1)
    assert [r["i"] for r in train.collect()] == [0]
    assert sorted(r["i"] for r in test.collect()) == [1, 2]
    lab = {r["i"]: r["split"] for r in splits.with_time_split(df, "ts", t0, t1).collect()}
    assert lab == {0: "train", 1: "test", 2: "test"}


def test_time_filter_pushed_to_scan(spark):
    from tests.conftest import SF_SMALL

    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    plan = relational.before(li, "l_shipdate", "1999-06-01 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "l_shipdate" in plan.split("PushedFilters")[1][:200]


def test_key_split_and_folds(spark):
    df = spark.range(-20, 20).withColumnRenamed("id", "k")
    tr, te = splits.key_split(df, "k", 10, 7)
    assert tr.count() + te.count() == 40
    assert all(r["k"] % 10 < 7 for r in tr.collect())
    folds = splits.with_folds(df, 3, key="k").select("fold").distinct().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2]


def test_null_keys_are_on_one_side_and_in_a_fold(spark):
    df = spark.createDataFrame([(1,), (8,), (None,), (None,)], "k long")
    train, test = splits.key_split(df, "k", 10, 7)
    assert [r["k"] for r in train.collect()] == [1] and sorted([r["k"] for r in test.collect()], key=str) == [8, None, None]
    named = splits.with_key_split(df, "k", 10, 7)
    assert named.where("split = 'train'").count() == 1 and named.where("split = 'test'").count() == 3
    for folds in (splits.with_folds(df, 3, "k"), splits.with_folds(df, 3, "k", seed=1)):
        assert {r["fold"] for r in folds.collect()} <= {0, 1, 2}
    parts = splits.random_split(df, [0.5, 0.5], 1, "k")
    assert sum(p.count() for p in parts) == 4


def test_folds_and_split_are_drawn_apart(spark):
    df = spark.range(0, 4000)
    train, _ = splits.random_split(df, [0.7, 0.3], 5, "id")
    sizes = [r["count"] for r in splits.with_folds(train, 5, "id", seed=5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 400


def test_filter_by_requires_boolean(spark):
    df = spark.createDataFrame([(True, "x"), (False, "y")], "b boolean, s string")
    assert relational.filter_by(df, "b").count() == 1
    with pytest.raises(TypeError):
        relational.filter_by(df, "s")


def test_view_and_sql(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    relational.register_view(df, "kw_tmp_view")
    assert relational.sql(df, "SELECT b FROM kw_tmp_view").first()["b"] == 2.0
