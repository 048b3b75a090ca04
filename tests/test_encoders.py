from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ordina.functions import classes as fc
from ordina.functions import features as ff
from ordina.operators import encode, quality
from ordina.sources import tables


def values(df):
    return [tuple(r) for r in df.collect()]


def test_division_policies(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert [v for (v,) in values(df.select(ff.divide("a", "b")))] == [None] * 5 + [1.5]
    got = [v for (v,) in values(df.select(ff.divide("a", "b", "ieee")))]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2])
    assert got[3:] == [None, None, 1.5]
    wide = df.select(ff.divide("a", "b", "ieee").alias("r"), F.lit("x").alias("text"))
    assert quality.inf_count(wide, ["r", "text"]).first()[0] == 2
    with pytest.raises(ValueError, match="infinite"):
        quality.check_finite(wide, ["r"])


def test_row_aggregates(spark):
    rows = [(1.0, 2.0, 3.0), (1.0, None, 3.0), (None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = df.select(
        ff.feat_row_mean("a", "b", "c"),
        ff.feat_null_count("a", "b", "c"),
        ff.feat_sum("a", "b", "c"),
        ff.sum_ignoring_nulls("a", "b", "c"),
        ff.feat_guarded_ratio("a", F.col("c") - 3),
    )
    assert values(got) == [
        (2.0, 0, 6.0, 6.0, None),
        (2.0, 1, None, 4.0, None),
        (None, 3, None, 0.0, None),
    ]


def test_labels(spark):
    maps = {"Spring": 0, "Fall": 2}
    df = spark.createDataFrame([("Spring",), ("Fall",), (None,)], "s string")
    assert values(df.select(fc.encode_label("s", maps))) == [(0,), (2,), (None,)]
    assert values(df.select(fc.fill_none("s"))) == [("Spring",), ("Fall",), ("none",)]
    bad = spark.createDataFrame([("Monsoon",)], "s string")
    with pytest.raises(Exception, match="no code for label: Monsoon"):
        bad.select(fc.encode_label("s", maps)).collect()


def test_mapper_file(spark, tmp_path):
    path = tmp_path / "mapper.json"
    path.write_text('{"main": {"c": {"a": 0,\n "b": 1}}}')
    assert tables.lookup_mapper(spark, str(path)) == {"c": {"a": 0, "b": 1}}


def test_one_hot(spark):
    train = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", None)], "many string, two string")
    test = spark.createDataFrame([("z", "x"), (None, "q"), ("a", "y")], "many string, two string")
    first, second = encode.one_hot_missing_zero(train, [test], ["many", "two"])
    assert first.columns == ["many=a", "many=b", "many=c", "two"]
    assert values(first) == [(0, 1, 0, 1), (1, 0, 0, -1), (0, 0, 1, 0)]
    assert values(second) == [(0, 0, 0, 1), (0, 0, 0, 0), (1, 0, 0, -1)]


def test_one_hot_of_many_labels(spark):
    train = spark.range(1500).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    done, other = encode.one_hot_missing_zero(train, [spark.createDataFrame([(None,)], "c string")], ["c"])
    assert len(done.columns) == 1500
    assert sum(other.first()) == 0 and sum(done.where("`c=v7` = 1").first()) == 1


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert encode.column_means(df, ["x"]).first().x == 2.0
    assert [r.x for r in encode.impute_train_mean(df, [], ["x"])[0].collect()] == [1.0, 2.0, 3.0, 2.0]


def test_robust_scaling(spark):
    rows = [(1.0, 5.0, 0.0), (1.0, 5.0, 1.0), (1.0, 5.0, 2.0), (9.0, 5.0, 3.0), (1.0, 5.0, None)]
    df = spark.createDataFrame(rows, "peak double, flat double, plain double")
    done, other = encode.robust_smooth_clip(
        df, [spark.createDataFrame([(1.0, 99.0, None)], df.schema)], df.columns
    )
    got = values(done)
    # No quartile range: half the full range; a constant column gives 0 everywhere.
    assert got[3][0] == pytest.approx(2.0 / math.sqrt(1 + 4 / 9))
    assert [r[1] for r in got] == [0.0] * 5 and got[4][2] == 0.0
    z = (3.0 - 1.5) / 1.5
    assert got[3][2] == pytest.approx(z / math.sqrt(1 + (z / 3) ** 2))
    assert values(other) == [(0.0, 0.0, 0.0)]


def test_imputers(spark):
    train = spark.createDataFrame([(1, 2.0), (None, 4.0), (3, None)], "c int, x double")
    other = spark.createDataFrame([(7, None), (None, 1.0)], "c int, x double")
    a, b = encode.impute_train_mean(train, [other], ["x"])
    assert values(a) == [(1, 2.0), (None, 4.0), (3, 3.0)] and values(b)[0] == (7, 3.0)
    a, b = encode.impute_max_plus_one(train, [other], ["c"])
    assert [r[0] for r in values(a)] == [1, 4, 3] and [r[0] for r in values(b)] == [7, 8]
    _, b = encode.impute_max_plus_one(train, [other], ["c"], per_split=False)
    assert [r[0] for r in values(b)] == [7, 4]


def test_standardized_target_comes_back(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "y double")
    (done,), moments = encode.standardize_target(df, [], "y")
    back = done.select(encode.unstandardize(F.col("y"), moments).alias("y"))
    assert [r.y for r in back.collect()] == pytest.approx([1.0, 2.0, 6.0])


def test_leaks(spark):
    rows = [("a", "t, v"), ("a", "v, t"), ("b", "v, t"), ("c", "n, t")]
    df = spark.createDataFrame(rows, "id string, fold_info string")
    assert tuple(quality.leaks_by_fold(df, "id", 2).first()) == (1, 1)
    with pytest.raises(ValueError, match="train and the validation"):
        quality.check_no_leaks(df, "id", 2)
    clean = df.where("id <> 'a'")
    quality.check_no_leaks(clean, "id", 2)
    with pytest.raises(ValueError, match="1 ids"):
        quality.check_no_leak(df.where("fold_info = 't, v'"), df.where("fold_info = 'v, t'"), "id")


def test_type_check(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    quality.check_numeric(df, ["x"])
    quality.check_numeric(df, ["x", "s"], allow_text=True)
    with pytest.raises(TypeError, match="s"):
        quality.check_numeric(df, ["x", "s"])


def test_subject_file_is_read_by_name(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text(
        "sii,extra,Physical-BMI,id,Basic_Demos-Sex,CGAS-Season\n"
        "2,a,16.5,0012,1.0,Fall\n,b,,0013,0,\n"
    )
    df = tables.scan_subjects(spark, str(path))
    assert values(df) == [
        (2.0, "a", 16.5, "0012", 1.0, "Fall"),
        (None, "b", None, "0013", 0.0, None),
    ]
    path.write_text("id,Physical-BMI\nx,heavy\n")
    with pytest.raises(Exception, match="MALFORMED"):
        tables.scan_subjects(spark, str(path)).collect()


def test_any_number_of_labels(spark):
    """Labels by place: numbers in their order, then texts; unseen and missing ones have none."""
    train = spark.range(30_000).select(
        (F.col("id") * 7 % 100_003).alias("code"), F.when(F.col("id") % 2 == 0, "b").when(F.col("id") % 3 == 0, "a").alias("kind"), "id"
    )
    other = spark.createDataFrame([(7, "a", -1), (8, "zz", -2), (None, None, -3)], "code long, kind string, id long")
    first, second = encode.one_hot_slots(train, [other], ["code", "kind"])
    codes = sorted(i * 7 % 100_003 for i in range(30_000))
    got = {r.id: (r.code_slot, r.kind_slot) for r in first.collect()}
    for i in (0, 1, 3, 29_999):
        kind = "b" if i % 2 == 0 else "a" if i % 3 == 0 else None
        assert got[i] == (codes.index(i * 7 % 100_003), {"a": 30_000, "b": 30_001, None: None}[kind])
    assert {r.id: (r.code_slot, r.kind_slot) for r in second.collect()} == {-1: (codes.index(7), 30_000), -2: (None, None), -3: (None, None)}
    with pytest.raises(ValueError, match="one_hot_slots"):
        encode.one_hot_missing_zero(train, [], ["code"])
