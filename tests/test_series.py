from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ordina.config import ColumnRoles, series_schema
from ordina.operators import series
from ordina.plans import preprocess
from ordina.sources import tables

ROWS = [
    # id, flag, day, x
    ("never", 1.0, 1.0, 5.0),
    ("never", 1.0, 2.0, 6.0),
    ("once", 0.0, 3.0, 2.5),
    ("once", 1.0, 4.0, 9.0),
    ("even", 0.0, None, 1.0),
    ("even", 0.0, 1.0, 4.0),
    ("even", 0.0, 1.0, 2.0),
    ("even", 0.0, 2.0, 10.0),
    ("even", None, 7.0, 99.0),
]


def summary(spark, parts, rows=ROWS):
    df = spark.createDataFrame(rows, "id string, flag double, day double, x double")
    df = df.repartition(parts)
    df = df.select("*", F.lit(3).cast("byte").alias("weekday"))
    done = series.series_summary(
        df, "id", ["x"], "flag", "day", ["weekday"], per_day=10, prefix="s_"
    )
    return {r.id: r.asDict() for r in done.collect()}


@pytest.mark.parametrize("parts", [1, 64])
def test_summary(spark, parts):
    got = summary(spark, parts)
    never, once, even = got["never"], got["once"], got["even"]
    assert [never[f"s_x_{n}"] for n in ("min", "max", "mean", "std", "median")] == [None] * 5
    assert never["s_total_day_registered"] == 0 and never["s_flag_mean"] == 1.0
    assert never["s_missing_data_mean"] == pytest.approx(2 / 20)
    assert once["s_x_std"] is None and once["s_x_median"] == 2.5
    assert once["s_total_day_registered"] == 1 and once["s_flag_mean"] == 0.5
    assert even["s_x_median"] == 3.0 and even["s_x_mean"] == 4.25
    assert even["s_x_std"] == pytest.approx(math.sqrt(16.25))
    # The null day is one more day, among the worn samples and overall.
    assert even["s_total_day_registered"] == 3
    assert even["s_missing_data_mean"] == pytest.approx(4 / (10 * 4))
    assert even["s_weekday_mean"] == 3.0


@pytest.mark.parametrize("parts", [1, 2, 3, 64])
def test_summary_with_nan(spark, parts):
    rows = [("a", 0.0, 1.0, x) for x in (4.0, float("nan"), 1.0, float("inf"))]
    got = summary(spark, parts, rows)["a"]
    assert got["s_x_median"] == math.inf and got["s_x_min"] == 1.0 and math.isnan(got["s_x_max"])


def test_ids_keep_their_spelling(spark, tmp_path):
    columns = {f.name: F.lit(0).cast(f.dataType) for f in series_schema().fields if f.name != "id"}
    ids = spark.createDataFrame([("0012",), ("1e5",), ("ab",)], "id string")
    tables.write_series(ids.withColumns(columns), str(tmp_path / "series"))
    found = tables.scan_series(spark, str(tmp_path / "series"))
    assert sorted(r.id for r in found.select("id").collect()) == ["0012", "1e5", "ab"]


def test_small_ids_share_files(spark, tmp_path):
    """Only the largest ids get a folder, so files do not multiply with ids; no row is lost."""
    path = tmp_path / "series"
    columns = {f.name: F.lit(0).cast(f.dataType) for f in series_schema().fields if f.name != "id"}
    ids = ["a"] * 3 + ["b"] * 5 + ["c", "d", "d", "", None, "0012", "d"]
    rows = spark.createDataFrame([(i,) for i in ids], "id string").withColumns(columns)
    tables.write_series(rows, str(path), rows_per_file=2, max_folders=2)
    assert sorted(p.name for p in path.glob("id=*")) == ["id=a", "id=b"]
    found = tables.scan_series(spark, str(path))
    assert found.columns == rows.select(*found.columns).columns and len(found.columns) == len(rows.columns)
    assert sorted(r.id or repr(r.id) for r in found.collect()) == sorted(i or repr(i) for i in ids)
    tables.write_series(rows, str(tmp_path / "none"), max_folders=0)
    assert tables.scan_series(spark, str(tmp_path / "none")).count() == len(ids)


def test_anchor_filter_reaches_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "series")
    columns = {f.name: F.lit(0).cast(f.dataType) for f in series_schema().fields if f.name != "id"}
    spark.range(3).select(F.col("id").cast("string")).withColumns(columns).write.parquet(path)
    df = series.filter_near_anchor(spark.read.parquet(path))
    df.select("X").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(relative_date_PCIAT,-30.0)" in plan
    assert "LessThanOrEqual(relative_date_PCIAT,30.0)" in plan
    assert "ReadSchema: struct<X:double,relative_date_PCIAT:double>" in plan


def test_fold_filter_prunes_the_gold_folders(spark, tmp_path, capsys):
    gold, rest = str(tmp_path / "gold"), str(tmp_path / "rest")
    rows = [("a", 1, "v, t"), ("b", 0, "t, v"), ("c", None, None)]
    df = spark.createDataFrame(rows, "id string, sii int, fold_info string")
    tables.sink_gold(df, "sii", gold, rest)
    assert spark.read.parquet(rest).columns == ["id", "sii"]
    from ordina.operators.folds import fold_view

    valid = fold_view(tables.scan_gold(spark, gold), 1)[1]
    assert [r.id for r in valid.collect()] == ["b"]
    valid.explain("formatted")
    assert "PartitionFilters: [isnotnull(fold_info" in capsys.readouterr().out


def test_summary_merges_partial_results_before_the_shuffle(spark, tmp_path, capsys):
    """Samples are aggregated before they are exchanged; only those inside a bracket are joined on."""
    path = str(tmp_path / "series")
    columns = {f.name: F.lit(0).cast(f.dataType) for f in series_schema().fields if f.name != "id"}
    spark.range(3).select(F.col("id").cast("string")).withColumns(columns).write.parquet(path)
    preprocess.summarise_series(spark.read.parquet(path), ColumnRoles()).explain("formatted")
    plan = capsys.readouterr().out.split("\n\n")[0]
    assert "Python" not in plan and "SinglePartition" not in plan
    lines = [line for line in plan.splitlines() if "(" in line]
    for above, below in zip(lines, lines[1:]):
        if " Exchange " in above:
            assert "Scan" not in below
