"""Running totals, exact quantiles and folds against brute force, with hot groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordina.functions.classes import bin_age, strata_key
from ordina.operators import explain, folds, quantiles, ranking


def hot_frame(n=3000, seed=1):
    """One key holds half of the rows; values have ties, nulls and long tails."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.5, "hot", [f"k{i}" for i in rng.integers(0, 40, n)])
    a = np.where(rng.random(n) < 0.3, 1.25, np.exp(rng.normal(0, 4, n)))
    b = rng.integers(-5, 5, n).astype(float)
    c = np.full(n, 7.0)
    frame = pd.DataFrame({"key": key, "a": a, "b": b, "c": c, "row": np.arange(n)})
    frame.loc[rng.random(n) < 0.1, "a"] = np.nan
    frame.loc[frame.key == "k3", "b"] = np.nan
    return frame


def as_spark(spark, frame):
    columns = [F.nanvl(F.col(c), F.lit(None)).alias(c) for c in ("a", "b", "c")]
    return spark.createDataFrame(frame).select("key", *columns, "row")


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_bracketed_quantiles_are_exact(spark, threshold):
    frame = hot_frame()
    df = as_spark(spark, frame)
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = quantiles.exact_quantiles(
            df, ["key"], ["a", "b", "c"], probs, ["row"], accuracy=25
        ).toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got.key) == sorted(frame.key.unique())
    for _, row in got.iterrows():
        part = frame[frame.key == row.key]
        for c in ("a", "b", "c"):
            values = part[c].dropna()
            if values.empty:
                assert row[c] is None
            else:
                np.testing.assert_allclose(row[c], np.quantile(values, probs), rtol=1e-12)


def test_bracketed_quantiles_of_a_whole_table(spark):
    frame = hot_frame(seed=2)
    got = quantiles.exact_quantiles(
        as_spark(spark, frame), [], ["a", "b"], (0.25, 0.5, 0.75), accuracy=25
    ).first()
    for c in ("a", "b"):
        np.testing.assert_allclose(got[c], np.quantile(frame[c].dropna(), (0.25, 0.5, 0.75)))


@pytest.mark.parametrize("parts", [1, 64])
@pytest.mark.parametrize("accuracy", [20, 1000])
def test_quantiles_with_nan_and_infinities(spark, parts, accuracy):
    """NaN ranks above all numbers, as in Spark's own percentile, however the rows are dealt."""
    rng = np.random.default_rng(4)
    inf, nan = float("inf"), float("nan")
    rows = []
    for i in range(2500):
        key = "hot" if i % 2 else f"k{i % 23}"
        x = nan if i % 10 == 0 else inf if i % 97 == 0 else -inf if i % 89 == 0 else float(rng.normal(0, 1e3))
        rows.append((key, None if i % 13 == 0 else x, i))
    rows += [("all", nan, -1), ("all", nan, -2), ("big", 1.7e308, -3), ("big", -1.7e308, -4), ("big", inf, -5)]
    df = spark.createDataFrame(rows, "key string, x double, row long").repartition(parts)
    probs = (0.0, 0.25, 0.5, 0.95, 1.0)
    got = {r.key: r.x for r in quantiles.exact_quantiles(df, ["key"], ["x"], probs, ["row"], accuracy=accuracy).collect()}
    for key in {r[0] for r in rows}:
        values = np.sort([x for k, x, _ in rows if k == key and x is not None])  # NaN comes last
        for p, found in zip(probs, got[key]):
            at = p * (len(values) - 1)
            low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
            want = low if low == high or np.isnan(low) else low * (1 - at % 1) + high * (at % 1)
            np.testing.assert_allclose(found, want, rtol=1e-9, err_msg=f"{key} {p}")


def test_hot_groups_get_cells(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ROWS_PER_CELL", 100)
    frame = hot_frame(seed=3)
    got = quantiles.exact_quantiles(as_spark(spark, frame), ["key"], ["a"], (0.5,), ["row"]).toPandas()
    for _, row in got.iterrows():
        np.testing.assert_allclose(row.a[0], frame[frame.key == row.key].a.median())



def test_running_total(spark):
    frame = hot_frame(seed=4).assign(w=lambda f: f.row % 7, bucket=lambda f: f.row // 100)
    df = spark.createDataFrame(frame[["key", "row", "w", "bucket"]])
    got = ranking.running_total(df, ["key"], ["bucket"], ["row"], F.col("w"), "upto").toPandas()
    want = frame.sort_values("row").assign(upto=lambda f: f.groupby("key").w.cumsum())
    merged = got.merge(want[["row", "upto"]], on="row")
    assert len(merged) == len(frame) and (merged.upto_x == merged.upto_y).all()


def test_shuffled_rank_is_a_permutation(spark):
    df = spark.createDataFrame(hot_frame(seed=5)[["key", "row"]])
    got = ranking.shuffled_rank(df, ["key"], "row", 3, "rank").toPandas()
    for _, part in got.groupby("key"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))
    hot = got[got.key == "hot"]
    assert (hot.sort_values("row")["rank"].diff().dropna() != 1).any()


strata_frames = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 3)), min_size=1, max_size=60
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=strata_frames, k=st.integers(2, 5), seed=st.integers(0, 5))
def test_fold_sizes_differ_by_at_most_one(spark, rows, k, seed):
    frame = pd.DataFrame(rows, columns=["s", "y"]).assign(id=lambda f: f.index.astype(str))
    df = spark.createDataFrame(frame)
    got = folds.stratified_folds(df, "id", F.concat("s", "y"), k, seed).toPandas()
    assert sorted(got.id) == sorted(frame.id)
    assert got.fold.between(0, k - 1).all()
    sizes = got.fold.value_counts().reindex(range(k), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for _, part in got.groupby(["s", "y"]):
        sizes = part.fold.value_counts().reindex(range(k), fill_value=0)
        assert sizes.max() - sizes.min() <= 1


def test_folds_do_not_depend_on_the_partitioning(spark):
    df = spark.range(500).select(F.col("id").cast("string"), (F.col("id") % 3).alias("y"))
    one = folds.stratified_folds(df.repartition(7), "id", F.col("y"), 5, 1)
    two = folds.stratified_folds(df.coalesce(1), "id", F.col("y"), 5, 1)
    assert sorted(one.collect()) == sorted(two.collect())
    other = folds.stratified_folds(df, "id", F.col("y"), 5, 2)
    assert sorted(one.collect()) != sorted(other.collect())


def test_age_bins_and_strata(spark):
    ages = [4.0, 7.0, 7.5, 8.0, 9.0, 10.0, 10.5, 12.0, 14.0, 14.5, None]
    df = spark.createDataFrame([(a, 2) for a in ages], "age double, y int")
    got = [tuple(r) for r in df.select(bin_age("age"), strata_key(bin_age("age"), F.col("y"))).collect()]
    bins = [0, 0, 1, 1, 2, 3, 4, 4, 5, 6, 6]
    assert got == [(b, f"{b}2") for b in bins]


def test_fold_flags(spark):
    df = spark.createDataFrame([(0,), (2,), (None,)], "fold int")
    got = [r.fold_info for r in folds.fold_info(df, "fold", 3).collect()]
    assert got == ["v, t, t", "t, t, v", "n, n, n"]


def test_null_ids_keep_their_rows(spark):
    rows = [(None if i % 5 == 0 else f"s{i}", float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, y double")
    dealt = folds.stratified_folds(df, "id", F.col("y"), 5, 1)
    sizes = {r["fold"]: r["count"] for r in dealt.groupBy("fold").count().collect()}
    assert sizes == {k: 40 for k in range(5)}
    pairs = explain.permuted_pairs(dealt, "id", ["y"], 2, 0)
    assert pairs.count() == 400


def test_folds_have_no_single_partition(spark, capsys):
    df = spark.range(1000).select(F.col("id").cast("string"), (F.col("id") % 3).alias("y"))
    folds.stratified_folds(df, "id", F.col("y"), 5).explain("formatted")
    assert "SinglePartition" not in capsys.readouterr().out


@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40, unique=True))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_prefix_starts(spark, keys):
    df = spark.createDataFrame([(k, abs(k)) for k in keys], "k int, w long")
    got = {r.k: r["__start"] for r in ranking.prefix_starts(df, ["k"], "w").collect()}
    assert got == {k: sum(abs(x) for x in keys if x < k) for k in keys}
