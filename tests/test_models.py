from __future__ import annotations

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordina.config import ColumnRoles
from ordina.functions.classes import fold_entry
from ordina.operators import explain, metrics, models, pseudo
from ordina.operators.metrics import qwk_threshold
from ordina.plans import inference, store, training
from ordina.sources import tables

CUTS = (0.5, 1.5, 2.5)
N_FOLD = 3
ROLES = ColumnRoles(numeric=("a", "b"), seasons=(), codes=("c",), n_fold=N_FOLD)


def gold_frame(n=180, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    c = rng.integers(0, 3, n).astype("int32")
    y = np.clip(np.round(1.5 + a + 0.5 * (c == 2) + rng.normal(0, 0.3, n)), 0, 3)
    fold = np.arange(n) % N_FOLD
    info = [", ".join("v" if f == k else "t" for k in range(N_FOLD)) for f in fold]
    frame = pd.DataFrame(
        {"id": [f"s{i}" for i in range(n)], "sii": y.astype("int32"), "a": a, "b": b, "c": c}
    )
    frame["fold_info"] = info
    frame.loc[::11, "b"] = np.nan
    return frame


@pytest.fixture(scope="module")
def gold(spark):
    df = spark.createDataFrame(gold_frame()).withColumn("b", F.nanvl("b", F.lit(None)))
    return df.withColumn("c", F.when(F.col("id") == "s7", None).otherwise(F.col("c"))).cache()


@pytest.fixture
def unused_path(tmp_path):
    return str(tmp_path / "rows")


@pytest.fixture(scope="module")
def boosted(gold):
    return models.cv_fit(gold, ["a", "b"], ["c"], "sii", models.boosted_trees(5, 3, 0.5), N_FOLD)


@pytest.fixture(scope="module")
def forests(gold):
    return models.cv_fit(
        gold, ["a", "b"], ["c"], "sii", models.forest(4, 3), N_FOLD, as_text=True
    )


def test_feature_spaces_see_train_rows_only(gold):
    frame = gold.toPandas()
    for k, space in enumerate(models.feature_spaces(gold, ["a", "b"], ["c"], N_FOLD)):
        train = frame[frame.fold_info.str.split(", ").str[k] == "t"]
        assert space.fills == pytest.approx({"a": train.a.mean(), "b": train.b.mean()})
        assert space.flagged == ("b",) and space.top_codes == {"c": 2}
        assert space.slot_owners == ["a", "b", "b", "c"]


class _Watched:
    """An estimator that only tells what it is given, and how many fit beside it."""

    def __init__(self):
        self.tasks, self.now, self.most = [], 0, 0

    def fit(self, df):
        self.now += 1
        self.most = max(self.most, self.now)
        self.tasks.append(df.rdd.getNumPartitions())
        time.sleep(0.3)
        self.now -= 1


def test_fits_have_bounded_tasks(gold):
    """Each task of a fit shuffles the statistics of all slots, so their number must not grow with the table."""
    watched = _Watched()
    models.cv_fit(gold.repartition(500), ["a", "b"], ["c"], "sii", lambda space: watched, N_FOLD)
    cores = gold.sparkSession.sparkContext.defaultParallelism
    assert watched.tasks == [models.FIT_TASKS_PER_CORE * cores] * N_FOLD
    assert watched.most > 1


def test_large_fits_run_one_by_one(gold, monkeypatch):
    """Fits keep their binned train rows; only as many run at once as there is room for."""
    monkeypatch.setattr(models, "FIT_BYTES_AT_ONCE", 1)
    watched = _Watched()
    models.cv_fit(gold, ["a", "b"], ["c"], "sii", lambda space: watched, N_FOLD)
    assert len(watched.tasks) == N_FOLD and watched.most == 1


class _Passing:
    """An estimator for trees that passes over its rows twice and tells how often they were made."""

    maxBins = None

    def __init__(self, made, loses=False):
        self.made, self.loses, self.told, self.rows = made, loses, [], []

    def fit(self, df):
        before = self.made.value
        self.rows += [df.agg(F.sum("__label")).first()[0], df.agg(F.sum("__label")).first()[0]]
        self.told.append(self.made.value - before)
        if self.loses and len(self.told) == 1:
            raise RuntimeError("[CHECKPOINT_RDD_BLOCK_ID_NOT_FOUND] Checkpoint block rdd_1_1 not found!")


def _counted_labels(gold, made):
    def seen(y):
        made.add(1)
        return y

    return gold.withColumn("y", F.udf(seen, "int")("sii"))


def test_rows_of_a_fit_are_made_once(gold):
    """Trees pass over their rows several times; the vectors are made before that and freed after."""
    context = gold.sparkSession.sparkContext
    passing = _Passing(context.accumulator(0))
    gold.count()  # it is cached itself
    kept = set(context._jsc.getPersistentRDDs())
    models.cv_fit(_counted_labels(gold, passing.made), ["a", "b"], ["c"], "y", lambda space: passing, N_FOLD, parallelism=1)
    assert passing.told == [0] * N_FOLD and passing.made.value == 180 * (N_FOLD - 1)
    assert passing.rows[::2] == passing.rows[1::2]
    assert set(context._jsc.getPersistentRDDs()) <= kept


def test_lost_rows_of_a_fit_are_made_again(gold):
    """A fit whose kept rows went with an executor takes them from the table."""
    passing = _Passing(gold.sparkSession.sparkContext.accumulator(0), loses=True)
    models.cv_fit(_counted_labels(gold, passing.made), ["a", "b"], ["c"], "y", lambda space: passing, 1)
    assert passing.told == [0, 240] and len(set(passing.rows)) == 1


def test_feature_spaces_of_many_columns(gold, monkeypatch):
    """Statistics taken a few columns at a time are those of one pass."""
    whole = models.feature_spaces(gold, ["a", "b"], ["c"], N_FOLD)
    monkeypatch.setattr(models, "COLUMNS_AT_ONCE", 1)
    apart = models.feature_spaces(gold, ["a", "b"], ["c"], N_FOLD)
    assert [(s.flagged, s.top_codes, s.train_rows) for s in apart] == [(s.flagged, s.top_codes, s.train_rows) for s in whole]
    for x, y in zip(apart, whole):
        assert x.fills == pytest.approx(y.fills)


def test_vectors(spark):
    space = models.FeatureSpace({"a": 9.0}, ("a",), {"c": 2}, {"s": ("1", "none", "it's")})
    rows = [(1.0, 2, "1"), (float("nan"), None, None), (None, 7, "it's"), (0.0, -1, "new")]
    df = spark.createDataFrame(rows, "a double, c int, s string")
    wide = space.assemble(df)
    assert [list(r.features) for r in wide.collect()] == [
        [1.0, 0.0, 2.0, 0.0],
        [9.0, 1.0, 3.0, 1.0],
        [9.0, 1.0, 3.0, 2.0],
        [0.0, 0.0, 3.0, 3.0],
    ]
    nominal = wide.schema["features"].metadata["ml_attr"]["attrs"]["nominal"]
    assert [(a["idx"], a["num_vals"]) for a in nominal] == [(2, 4), (3, 4)]


def test_linear_model_matches_least_squares(gold):
    fitted = models.cv_fit(gold, ["a"], [], "sii", models.linear(), N_FOLD)
    frame = gold.toPandas()
    for m in fitted:
        train = frame[frame.fold_info.str.split(", ").str[m.fold] == "t"]
        slope, intercept = np.polyfit(train.a, train.sii, 1)
        assert (m.model.coefficients[0], m.model.intercept) == pytest.approx((slope, intercept))


@pytest.mark.parametrize("kind", ["boosted", "forests"])
def test_cut_models_sum_their_first_trees(request, gold, kind):
    for m in request.getfixturevalue(kind):
        whole = m.score(gold, "x", ["id"]).toPandas().set_index("id").x
        summed = m.cut(m.n_trees).score(gold, "x", ["id"]).toPandas().set_index("id").x
        np.testing.assert_allclose(summed.loc[whole.index], whole, atol=1e-12)
        first = m.cut(1).score(gold, "x", ["id"]).toPandas().x
        assert set(np.round(first, 9)) <= {round(v, 9) for v in m.trees[0].leaf_values}


@pytest.mark.parametrize("kind", ["boosted", "forests"])
def test_staged_metric_equals_scoring_each_cut(request, gold, kind):
    fitted = request.getfixturevalue(kind)
    curve = models.staged_metric(fitted, gold, "sii", CUTS).toPandas()
    assert len(curve) == N_FOLD * fitted[0].n_trees
    for i in (0, fitted[0].n_trees - 1):
        cut = models.shrink_to_best(fitted, i + 1)
        scored = models.oof_predict(cut, gold, keep=["sii"])
        want = qwk_threshold(scored, "sii", "pred", CUTS, ["fold"]).toPandas()
        got = curve[curve.iter == i].set_index("fold").value
        np.testing.assert_allclose(got.loc[want.fold], want.qwk)


def test_oof_scores_every_row_once(gold, boosted):
    scored = models.oof_predict(boosted, gold, keep=["id"]).toPandas()
    assert sorted(scored.id) == sorted(gold.toPandas().id)


def test_blends_agree(gold, boosted):
    wide = models.blend_score(boosted, gold).select("id", "pred").toPandas().set_index("id").pred
    keyed = models.blend_folds(models.predict_folds(boosted, gold, "id", "m"), "id", N_FOLD)
    keyed = keyed.toPandas().set_index("id").pred
    np.testing.assert_allclose(keyed.loc[wide.index], wide)


def coalition_value(tree, x, known):
    """Expected tree output when only the features in `known` are observed."""

    def walk(node):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            codes = tree.left_codes[node]
            goes_left = x[f] in codes if codes is not None else x[f] <= tree.threshold[node]
            return walk(left if goes_left else right)
        share = tree.cover[left] / tree.cover[node]
        return share * walk(left) + (1 - share) * walk(right)

    return walk(0)


def brute_shapley(tree, x):
    n = len(x)
    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - 1 - size) / math.factorial(n)
            for s in itertools.combinations(others, size):
                out[i] += weight * (
                    coalition_value(tree, x, {*s, i}) - coalition_value(tree, x, set(s))
                )
    return out


@pytest.mark.parametrize("kind", ["boosted", "forests"])
def test_contributions_are_shapley_values(request, gold, kind):
    fitted = request.getfixturevalue(kind)
    rows = explain.contributions(fitted, gold, "id").collect()
    scores = {r.id: r.pred for r in models.oof_predict(fitted, gold, keep=["id"]).collect()}
    assert len(rows) == len(scores)
    for r in rows:
        assert r.bias + sum(r.contributions) == pytest.approx(scores[r.id], abs=1e-9)
    m = fitted[0]
    vectors = {r.id: np.array(r.features) for r in m.space.assemble(gold, ["id"]).collect()}
    scale = 1 / sum(m.weights) if m.averages else 1.0
    for r in [r for r in rows if r.fold == 0][:6]:
        slots = sum(
            w * scale * brute_shapley(t, vectors[r.id]) for t, w in zip(m.trees, m.weights)
        )
        want = [
            sum(v for v, owner in zip(slots, m.space.slot_owners) if owner == f)
            for f in m.space.features
        ]
        np.testing.assert_allclose(r.contributions, want, atol=1e-9)


def test_importances_find_the_driving_feature(spark, gold, boosted):
    tables = training.explain_member(boosted, gold, ROLES, repeats=2)
    for name, table in tables.items():
        rows = table.collect()
        assert sorted(r.feature for r in rows) == ["a", "b", "c"], name
        assert rows[0].feature == "a", name
        assert rows[0].importance > 0, name


def test_gain_is_zero_for_unused_features(spark, gold):
    fitted = models.cv_fit(
        gold.withColumn("flat", F.lit(1.0)), ["a", "flat"], [], "sii", models.boosted_trees(2, 2), N_FOLD
    )
    got = {r.feature: r.importance for r in explain.gain_importance(spark, fitted).collect()}
    assert got["flat"] == 0.0 and got["a"] > 0


def test_permuted_pairs_keep_each_fold_whole(gold):
    df = gold.select("id", "a", (F.substring("fold_info", 1, 1) == "v").cast("int").alias("fold"))
    pairs = explain.permuted_pairs(df, "id", ["a"], 2, 0).toPandas()
    own = df.toPandas()
    for (fold, _), part in pairs.groupby(["fold", "repeat"]):
        want = sorted(own[own.fold == fold].a)
        assert sorted(part.a) == want
        assert sorted(p["a"] for p in part["__partner"]) == want
        assert (part.a != part["__partner"].map(lambda p: p["a"])).mean() > 0.9


def test_rounds_relabel_from_the_original_rows(spark, gold):
    unlabelled = gold.limit(20).drop("fold_info").withColumn("sii", F.lit(None).cast("int"))
    unlabelled = unlabelled.withColumn("id", F.concat(F.lit("u"), "id"))
    member = training.Member("boosted", models.boosted_trees(3, 2, 0.5), CUTS)
    seen = []

    def store(name, data):
        seen.append((name, data.count(), data.where("fold_info like '%n%'").count()))
        return data.cache()

    def train_round(name, data):
        return training.fit_round(member, data, ROLES, name)[0]

    rounds, scores = pseudo.pseudo_rounds(train_round, gold, unlabelled, "sii", 2, store)
    n = gold.count()
    assert seen == [
        ("main_pseudo_0", n + 20 * N_FOLD, 20 * N_FOLD),
        ("main_pseudo_1", n + 20 * N_FOLD, 20 * N_FOLD),
    ]
    assert [r.name for r in scores.orderBy("round").collect()] == ["main", *[s[0] for s in seen]]
    assert all(r.best_iter is not None for r in rounds)


def test_two_members_to_a_submission(spark, gold, boosted, forests, tmp_path):
    members = {"boosted": boosted, "forest": forests}
    best = inference.search_blend(members, gold, ROLES).first()
    assert best.score > 0.5
    cuts = (best.t1, best.t2, best.t3)
    test = gold.drop("sii", "fold_info")
    raw = inference.submit(members, test, ROLES, str(tmp_path / "raw"), None).toPandas()
    classes = inference.submit(members, test, ROLES, str(tmp_path / "classes"), cuts).toPandas()
    both = raw.merge(classes, on="id")
    assert len(both) == test.count()
    assert (both.sii_y == np.searchsorted(cuts, both.sii_x, side="right")).all()


def test_train_member_writes_its_results(spark, gold, tmp_path):
    member = training.Member("boosted", models.boosted_trees(2, 2, 0.5), CUTS)
    unlabelled = gold.drop("fold_info").withColumn("sii", F.lit(None).cast("int"))
    best, scores = training.train_member(
        member, gold, unlabelled, ROLES, n_pseudo=0, results_root=str(tmp_path)
    )
    assert best.name == "main" and scores.count() == 1
    found = spark.read.parquet(str(tmp_path / "boosted" / "main" / "thresholds")).first()
    assert found["score"] == best.best["score"] and "gain" in found.asDict()


def test_gain_kinds(spark, boosted):
    total = {(r.fold, r.feature): r.importance for r in explain.gain_by_fold(spark, boosted).collect()}
    mean = {(r.fold, r.feature): r.importance for r in explain.gain_by_fold(spark, boosted, "mean").collect()}
    for m in boosted:
        for f in m.space.features:
            splits = sum(m.space.slot_owners[s] == f for t in m.trees for s in t.feature if s >= 0)
            assert mean[m.fold, f] == pytest.approx(total[m.fold, f] / splits if splits else 0.0)
    with pytest.raises(ValueError):
        explain.gain_by_fold(spark, boosted, "other")


@pytest.mark.parametrize("kind", ["boosted", "forests"])
def test_members_come_back(request, spark, gold, tmp_path, kind):
    fitted = models.shrink_to_best(request.getfixturevalue(kind), 3)
    done = pseudo.Round("main", fitted, {"t1": 0.5, "score": 0.25}, 3)
    store.save_member(done, str(tmp_path / kind))
    back = store.load_member(spark, str(tmp_path / kind))
    assert (back.name, back.best, back.best_iter) == (done.name, done.best, done.best_iter)
    for m, b in zip(fitted, back.models):
        assert b.space == m.space and b.upto == 3 and b.averages == m.averages
        want = m.score(gold, "x", ["id"]).toPandas().set_index("id").x
        got = b.score(gold, "x", ["id"]).toPandas().set_index("id").x
        np.testing.assert_allclose(got.loc[want.index], want, atol=1e-12)


def test_several_metrics_of_the_curve(gold, boosted):
    named = {
        "kappa": metrics.threshold_kappa(CUTS),
        "rounded": metrics.rounded_kappa(),
        "mse": metrics.squared_error(),
        "bias": metrics.column_metric(lambda y, p: F.avg(p - y)),
    }
    curve = models.staged_metric(boosted, gold, "sii", metrics=named).toPandas()
    assert len(curve) == N_FOLD * 5 * 4
    plain = models.staged_metric(boosted, gold, "sii", CUTS).toPandas().set_index(["fold", "iter"]).value
    kappa = curve[curve.metric == "kappa"].set_index(["fold", "iter"]).value
    np.testing.assert_allclose(kappa.loc[plain.index], plain)
    scored = models.oof_predict(models.shrink_to_best(boosted, 2), gold, keep=["sii"]).toPandas()
    for name, want in (("mse", ((scored.sii - scored.pred) ** 2)), ("bias", scored.pred - scored.sii)):
        got = curve[(curve.metric == name) & (curve.iter == 1)].set_index("fold").value
        np.testing.assert_allclose(got.sort_index(), want.groupby(scored.fold).mean().sort_index())


def test_all_folds_score_in_one_pass(gold, boosted, unused_path, capsys):
    gold.write.parquet(unused_path)
    rows = gold.sparkSession.read.parquet(unused_path)
    for df in (
        models.predict_folds(boosted, rows, "id", "m"),
        pseudo.pseudo_rows(boosted, rows, "sii", rows.columns),
        models.predict_members({"a": boosted, "b": boosted}, rows, "id"),
    ):
        df.explain("formatted")
        assert capsys.readouterr().out.split("\n\n")[0].count("Scan parquet") == 1


def test_unused_features_have_no_importance(gold, boosted):
    wide = gold.withColumn("noise", F.lit(1.0))
    fitted = models.cv_fit(wide, ["a", "b", "noise"], ["c"], "sii", models.boosted_trees(2, 2, 0.5), N_FOLD)
    table = explain.permutation_importance(fitted, wide, "id", "sii", ["a", "noise"], 1)
    got = {r.feature: r.importance for r in table.collect()}
    assert got["noise"] == 0.0 and got["a"] > 0


def test_many_text_labels(spark):
    rows = [(f"s{i}", float(i % 4), f"v{i}", "t, v" if i % 2 else "v, t") for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, sii double, c string, fold_info string")
    spaces = models.feature_spaces(df, [], ["c"], 2, as_text=True)
    assert [len(s.labels["c"]) for s in spaces] == [1500, 1500]
    assert spaces[0].labels["c"][0] == "v1" and spaces[1].labels["c"][0] == "v0"


def test_best_iteration_of_every_model(spark):
    rows = [(m, k, i, "q_kappa", float(i if m == "a" else -i)) for m in "ab" for k in (0, 1) for i in range(4)]
    curve = spark.createDataFrame(rows, "model string, fold int, iter int, metric string, value double")
    got = {r.model: (r.best_iter, r["mean"]) for r in models.best_iteration(curve).collect()}
    assert got == {"a": (4, 3.0), "b": (1, 0.0)}


def test_categories_with_too_many_labels_are_hashed(gold, tmp_path):
    wide = gold.withColumn("many", F.col("id"))
    spaces = models.feature_spaces(wide, ["a"], ["c", "many"], N_FOLD, as_text=True, max_labels=8)
    assert all(s.hashed == {"many": 8} and list(s.labels) == ["c"] for s in spaces)
    assert spaces[0].features == ["a", "c", "many"] and spaces[0].cardinalities[-1] == 8
    slots = wide.select(F.expr(spaces[0].slots_sql).alias("x")).collect()
    assert {r.x[-1] for r in slots} == set(map(float, range(8)))
    fitted = models.cv_fit(wide, ["a"], ["c", "many"], "sii", models.forest(2, 3), 2, as_text=True, max_labels=8)
    store.save_member(pseudo.Round("r", fitted, {}), str(tmp_path / "m"))
    loaded = store.load_member(wide.sparkSession, str(tmp_path / "m")).models
    assert [m.space for m in loaded] == [m.space for m in fitted]


def test_scores_of_a_pseudo_labelled_set_are_narrow(spark, gold, boosted, tmp_path):
    """The stored scores hold no feature, and with the tables they give the same rows."""
    rest = gold.limit(40).withColumn("id", F.concat(F.lit("u"), "id")).drop("fold_info").withColumn("sii", F.lit(None).cast("int"))
    rest = spark.createDataFrame(rest.collect(), rest.schema)
    test = rest.drop("sii").withColumn("id", F.concat(F.lit("t"), "id"))
    for more in (None, test):
        path = str(tmp_path / f"scores-{more is None}")
        tables.sink_pseudo(pseudo.pseudo_scores(boosted, rest, "id", more), path)
        scores = tables.scan_gold(spark, path)
        assert sorted(scores.columns) == ["fold_info", "id", "part", "score"]
        got = pseudo.pseudo_set(gold, rest, scores, "id", "sii", more)
        want = pseudo.pseudo_label(boosted, gold, rest, "sii", more)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_fold_reads_its_own_scores(spark, gold, boosted, tmp_path, capsys):
    rest = gold.drop("fold_info").withColumn("sii", F.lit(None).cast("int"))
    tables.sink_pseudo(pseudo.pseudo_scores(boosted, rest, "id"), str(tmp_path / "scores"))
    data = pseudo.pseudo_set(gold, rest, tables.scan_gold(spark, str(tmp_path / "scores")), "id", "sii")
    data.where(fold_entry("fold_info", 1) == "t").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(fold_info" in plan or "element_at(split(fold_info" in plan.split("PartitionFilters")[1][:300]


def test_cut_models_walk_a_row_once(gold, boosted, forests, capsys):
    cut = [m.cut(2) for m in (*boosted, *forests)]
    models.blend_score(cut, gold.select("id", "a", "b", "c")).explain("extended")
    plan = capsys.readouterr().out
    # No call for each tree, and no vector of all slots for each of them.
    assert "UDF" not in plan and "array_to_vector" not in plan
