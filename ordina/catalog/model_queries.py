"""Queries on fitted models.

Least squares on one feature has a closed form that SQL can state. Tree models
have none; what must hold for them exactly (contributions adding up, a cut model
scoring like the full one) is stated as a result that SQL knows beforehand.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.catalog import inputs as I
from ordina.catalog.inputs import ROLES, r6, rounded, sql_r6
from ordina.catalog.metric_queries import (
    LABELLED_SQL,
    UNLABELLED_SQL,
    best_sql,
    class_sql,
    labelled_docs,
    unlabelled_docs,
)
from ordina.catalog.preprocess_queries import FEATURE_COLUMNS, gold, test_features
from ordina.catalog.registry import query
from ordina.config import BASE_THRESHOLDS, TARGET
from ordina.functions.classes import fold_entry
from ordina.operators import ensemble, explain, metrics, models, pseudo
from ordina.operators.metrics import qwk_threshold
from ordina.operators.models import PRED, FoldModel
from ordina.operators.thresholds import grid_cross
from ordina.plans import inference, store, training
from ordina.session import fresh_path, written
from ordina.sources import tables

N_FOLD = ROLES.n_fold
GOLD_IDS = f"(SELECT id FROM {I.subjects_sql()} s WHERE sii IS NOT NULL)"


# --- least squares -----------------------------------------------------------


def length_rows(spark, sf_dir) -> DataFrame:
    return labelled_docs(spark, sf_dir).withColumn("length", F.col("n_chars") / 1000)


def line_models(spark, sf_dir) -> list[FoldModel]:
    return models.cv_fit(length_rows(spark, sf_dir), ["length"], [], "y", models.linear(), N_FOLD)


LINES = " UNION ALL ".join(
    f"SELECT {k} AS fold, regr_slope(y, n_chars / 1e3) AS slope,"
    f" regr_intercept(y, n_chars / 1e3) AS intercept"
    f" FROM {LABELLED_SQL} l WHERE doc_id % 5 <> {k}"
    for k in range(N_FOLD)
)


@query("cv_fit", f"SELECT fold, {sql_r6('slope')} AS slope, {sql_r6('intercept')} AS intercept FROM ({LINES}) f")
def cv_fit(spark, sf_dir):
    """One line per fold, fitted on the fold's train rows."""
    rows = [
        (m.fold, float(m.model.coefficients[0]), float(m.model.intercept))
        for m in line_models(spark, sf_dir)
    ]
    lines = spark.createDataFrame(rows, "fold int, slope double, intercept double")
    return rounded(lines, ["fold"])


@query("oof_predict_fitted", f"SELECT doc_id, CAST(doc_id % 5 AS INT) AS fold, {sql_r6('slope * n_chars / 1e3 + intercept')} AS pred FROM {LABELLED_SQL} l JOIN ({LINES}) f ON f.fold = doc_id % 5")
def oof_predict_fitted(spark, sf_dir):
    scored = models.oof_predict(line_models(spark, sf_dir), length_rows(spark, sf_dir))
    return scored.select("doc_id", "fold", r6(PRED).alias("pred"))


# --- trees -------------------------------------------------------------------


def member(name: str) -> training.Member:
    estimators = {"boosted": models.boosted_trees(8, 3, 0.3), "forest": models.forest(8, 4)}
    return training.Member(name, estimators[name], text_categories=name == "forest")


def stored(spark, sf_dir, name: str) -> str:
    """Folder of a member that was fitted on the gold table and stored, with its result tables."""

    def make():
        root = fresh_path(spark, f"member-{name}")
        done, made = training.fit_round(member(name), gold(spark, sf_dir), ROLES)
        store.save_member(done, f"{root}/member")
        tables.sink_results(made, f"{root}/results")
        return root

    return I.input_path(spark, sf_dir, f"stored-{name}", make)


def fitted(spark, sf_dir, name: str = "boosted") -> pseudo.Round:
    """A member cut to its best iteration, as it is loaded from its files."""
    return store.load_member(spark, f"{stored(spark, sf_dir, name)}/member")


def uncut(fold_models) -> list[FoldModel]:
    return [m.cut(m.n_trees) for m in fold_models]


def score_gaps(fold_models, rows: DataFrame, part: str, keep: list[str]) -> DataFrame:
    """Spark's own score of each fold's rows next to the sum of their leaves."""
    both = []
    for m in fold_models:
        mine = rows.where(fold_entry("fold_info", m.fold) == part)
        whole = FoldModel(m.fold, m.space, m.model).score(mine, "whole")
        scored = m.score(whole, "summed", [*keep, "whole"])
        both.append(scored.withColumn("fold", F.lit(m.fold)))
    return models.union_all(both).withColumn("gap", F.abs(F.col("whole") - F.col("summed")))


@query("cv_fit_trees", f"SELECT CAST(f.fold AS INT) AS fold, CAST(8 AS BIGINT) AS n_trees, 0e0 AS gap FROM {GOLD_IDS} g, range(5) f(fold) GROUP BY 1")
def cv_fit_trees(spark, sf_dir):
    """Trees fitted per fold and the largest gap between Spark's score of a train row
    and the sum of its leaves."""
    rows = gold(spark, sf_dir)
    numeric, codes = training.feature_roles(rows, ROLES)
    fresh = models.cv_fit(rows, numeric, codes, TARGET, member("boosted").estimator, N_FOLD)
    counts = spark.createDataFrame([(m.fold, m.n_trees) for m in fresh], "fold int, n_trees long")
    gaps = score_gaps(uncut(fresh), rows, "t", []).groupBy("fold").agg(r6(F.max("gap")).alias("gap"))
    return counts.join(gaps, "fold")


FOLDS_AND_TREES = f"{GOLD_IDS} g, range(5) f(fold), range(8) i(iter)"


@query("staged_metric", f"SELECT CAST(fold AS INT) AS fold, CAST(iter AS INT) AS iter, 0e0 AS gap FROM {FOLDS_AND_TREES} GROUP BY 1, 2")
def staged_metric(spark, sf_dir):
    """The validation curve against the kappa of the rows' scores after every tree."""
    fold_models, rows = uncut(fitted(spark, sf_dir).models), gold(spark, sf_dir)
    curve = models.staged_metric(fold_models, rows, TARGET)
    scores = models.staged_scores(fold_models, rows, [TARGET])
    direct = qwk_threshold(scores, TARGET, PRED, BASE_THRESHOLDS, ["fold", "iter"])
    gap = F.abs(F.col("value") - F.col("qwk"))
    return curve.join(direct, ["fold", "iter"], "full").select(
        "fold", "iter", r6(F.coalesce(gap, F.lit(9.0))).alias("gap")
    )


@query("staged_metrics", f"SELECT CAST(fold AS INT) AS fold, metric, 0e0 AS gap FROM {GOLD_IDS} g, range(5) f(fold), (VALUES ('kappa'), ('rounded'), ('mse')) m(metric) GROUP BY 1, 2")
def staged_metrics(spark, sf_dir):
    """Three metrics from one pass, at the last tree, against scores of the whole model."""
    fold_models, rows = uncut(fitted(spark, sf_dir).models), gold(spark, sf_dir)
    several = {
        "kappa": metrics.threshold_kappa(BASE_THRESHOLDS),
        "rounded": metrics.rounded_kappa(),
        "mse": metrics.squared_error(),
    }
    last = models.staged_metric(fold_models, rows, TARGET, metrics=several).where("iter = 7")
    scored = written(models.oof_predict(fold_models, rows, keep=[TARGET]), "scored")
    error = F.avg(F.pow(F.col(TARGET) - F.col(PRED), F.lit(2))).alias("want")
    direct = {
        "kappa": metrics.qwk_threshold(scored, TARGET, PRED, BASE_THRESHOLDS, ["fold"]),
        "rounded": metrics.qwk_round(scored, TARGET, PRED, ["fold"]),
        "mse": scored.groupBy("fold").agg(error),
    }
    want = models.union_all([d.toDF("fold", "want").withColumn("metric", F.lit(n)) for n, d in direct.items()])
    return last.join(want, ["fold", "metric"]).select(
        "fold", "metric", r6(F.abs(F.col("value") - F.col("want"))).alias("gap")
    )


@query("oof_predict_trees", f"SELECT id, 0e0 AS gap FROM {GOLD_IDS} g")
def oof_predict_trees(spark, sf_dir):
    """Validation scores against Spark's own, row by row."""
    fold_models, rows = uncut(fitted(spark, sf_dir).models), gold(spark, sf_dir)
    scored = models.oof_predict(fold_models, rows, keep=["id"])
    own = score_gaps(fold_models, rows, "v", ["id"]).select("id", "whole")
    return scored.join(own, "id").select("id", r6(F.abs(F.col(PRED) - F.col("whole"))).alias("gap"))


@query("shrink_to_best", f"SELECT id, 0e0 AS gap FROM {GOLD_IDS} g")
def shrink_to_best(spark, sf_dir):
    """A model cut to its best tree count against the first terms of its sum."""
    done = fitted(spark, sf_dir)
    cut = models.oof_predict(done.models, gold(spark, sf_dir), keep=["id"])
    contribs = explain.contributions(done.models, gold(spark, sf_dir), "id")
    total = F.col("bias") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    return cut.join(contribs, "id").select("id", r6(F.abs(F.col(PRED) - total)).alias("gap"))


@query("gain_importance", f"SELECT CAST(fold AS INT) AS fold, kind, 0e0 AS gap FROM {GOLD_IDS} g, range(5) f(fold), (VALUES ('total'), ('mean')) k(kind) GROUP BY 1, 2")
def gain_importance(spark, sf_dir):
    """Shares of the total gain against Spark's own importances, and the mean gain times
    the splits against the total; per fold the largest gap."""
    fold_models = uncut(fitted(spark, sf_dir).models)
    own = []
    for m in fold_models:
        shares = dict.fromkeys(m.space.features, 0.0)
        splits = dict.fromkeys(m.space.features, 0)
        for owner, share in zip(m.space.slot_owners, m.model.featureImportances.toArray()):
            shares[owner] += float(share)
        for tree in m.trees:
            for f in tree.feature[tree.feature >= 0]:
                splits[m.space.slot_owners[f]] += 1
        own += [(m.fold, f, shares[f], splits[f]) for f in m.space.features]
    own = spark.createDataFrame(own, "fold int, feature string, share double, splits long")
    total = explain.gain_by_fold(spark, fold_models)
    mean = explain.gain_by_fold(spark, fold_models, "mean").withColumnRenamed("importance", "mean")
    rows = total.join(mean, ["fold", "feature"]).join(own, ["fold", "feature"])
    whole = rows.groupBy("fold").agg(F.sum("importance").alias("whole"))
    rows = rows.join(whole, "fold")
    gaps = {
        "total": F.max(F.abs(F.col("importance") / F.col("whole") - F.col("share"))),
        "mean": F.max(F.abs(F.col("mean") * F.col("splits") - F.col("importance")) / F.col("whole")),
    }
    return models.union_all(
        [
            rows.groupBy("fold").agg(r6(gap).alias("gap")).select("fold", F.lit(kind).alias("kind"), "gap")
            for kind, gap in gaps.items()
        ]
    )


@query("contributions", f"SELECT id, 0e0 AS gap FROM {GOLD_IDS} g")
def contributions(spark, sf_dir):
    """Contributions of every validation row against its score; the gaps are zero."""
    fold_models = uncut(fitted(spark, sf_dir, "forest").models)
    rows = gold(spark, sf_dir)
    scored = models.oof_predict(fold_models, rows, keep=["id"])
    contribs = explain.contributions(fold_models, rows, "id")
    total = F.col("bias") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    return scored.join(contribs, "id").select("id", r6(F.abs(F.col(PRED) - total)).alias("gap"))


@query("mean_abs_contrib", f"SELECT CAST({len(FEATURE_COLUMNS)} AS BIGINT) AS n, 0e0 AS gap")
def mean_abs_contrib(spark, sf_dir):
    """The table against one plain average per feature over wide rows."""
    fold_models = fitted(spark, sf_dir).models
    names = fold_models[0].space.features
    contribs = written(explain.contributions(fold_models, gold(spark, sf_dir), "id"), "contributions")
    table = explain.rank_features(explain.mean_abs_contrib(contribs, names), "importance")
    each = [F.avg(F.abs(F.get("contributions", F.lit(i)))).alias(f"v{i}") for i in range(len(names))]
    by_fold = contribs.groupBy("fold").agg(*each)
    plain = by_fold.agg(F.array(*[F.avg(f"v{i}") for i in range(len(names))]).alias("v"))
    plain = plain.select(F.posexplode("v").alias("i", "want"))
    plain = plain.select("want", F.get(F.lit(names), F.col("i")).alias("feature"))
    return table.join(plain, "feature").agg(
        F.count(F.lit(1)).alias("n"), r6(F.max(F.abs(F.col("importance") - F.col("want")))).alias("gap")
    )


@query("contributions_series", f"SELECT s.id, 0e0 AS gap FROM {GOLD_IDS} s WHERE s.id IN (SELECT CAST(user_id AS VARCHAR) FROM events WHERE abs((extract(doy FROM ts) - 16) * 3) <= 30)")
def contributions_series(spark, sf_dir):
    """Contributions of the rows with series data; with the bias they give the score."""
    fold_models, rows = fitted(spark, sf_dir).models, gold(spark, sf_dir)
    contribs = written(explain.contributions_series(fold_models, rows, "id"), "contributions")
    total = F.col("bias") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    scored = models.oof_predict(fold_models, rows, keep=["id"])
    return contribs.join(scored, "id").select("id", r6(F.abs(F.col(PRED) - total)).alias("gap"))


@query("permutation_importance_trees", f"SELECT CAST({len(FEATURE_COLUMNS)} AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_wrong")
def permutation_importance_trees(spark, sf_dir):
    """All features, shuffled in turn under the boosted trees: those without gain have
    exactly no importance, and none is above the kappa range."""
    fold_models = fitted(spark, sf_dir).models
    names = fold_models[0].space.features
    table = explain.rank_features(
        explain.permutation_importance(fold_models, gold(spark, sf_dir), "id", TARGET, names), "importance"
    )
    gain = explain.gain_importance(spark, fold_models).withColumnRenamed("importance", "gain")
    wrong = ((F.col("gain") == 0) & (F.col("importance") != 0)) | (F.abs("importance") > 2)
    return table.join(gain, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("n_wrong")
    )


# --- rounds, stored members and submissions of least squares -------------------

LINE_GRID = grid_cross(points=5)
LINE_ROLES = replace(ROLES, id_col="doc_id", target="y", numeric=("length",), seasons=(), codes=())
LINE = training.Member("line", models.linear(), grid=LINE_GRID)
OOF_SQL = f"SELECT doc_id, CAST(doc_id % 5 AS INT) AS fold, y, slope * n_chars / 1e3 + intercept AS pred FROM {LABELLED_SQL} l JOIN ({{lines}}) f ON f.fold = doc_id % 5"
# Fold k's second line also sees the unlabelled rows with its first line's score.
LINES_AGAIN = " UNION ALL ".join(
    f"SELECT {k} AS fold, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM ("
    f"SELECT CAST(y AS DOUBLE) AS y, n_chars / 1e3 AS x FROM {LABELLED_SQL} l WHERE doc_id % 5 <> {k}"
    f" UNION ALL SELECT slope * n_chars / 1e3 + intercept, n_chars / 1e3 FROM {UNLABELLED_SQL} u,"
    f" ({LINES}) f WHERE f.fold = {k}) t"
    for k in range(N_FOLD)
)


def line_table(spark, sf_dir) -> DataFrame:
    return length_rows(spark, sf_dir).select("doc_id", "y", "length", "fold_info")


def line_rest(spark, sf_dir) -> DataFrame:
    rest = unlabelled_docs(spark, sf_dir).withColumn("length", F.col("n_chars") / 1000)
    return rest.select("doc_id", "y", "length")


def _best_score_sql(number: int, name: str, lines: str) -> str:
    best = best_sql(LINE_GRID, f"({OOF_SQL.format(lines=lines)})")
    return f"SELECT {number} AS round, '{name}' AS name, {sql_r6('score')} AS score FROM ({best}) b{number}"


@query("pseudo_rounds", f"{_best_score_sql(0, 'main', LINES)} UNION ALL {_best_score_sql(1, 'main_pseudo_0', LINES_AGAIN)}")
def pseudo_rounds(spark, sf_dir):
    """Score of the first fit and of one refit with pseudo-labelled rows."""
    scores = training.train_member(
        LINE, line_table(spark, sf_dir), line_rest(spark, sf_dir), LINE_ROLES, n_pseudo=1
    )[1]
    return rounded(scores, ["round", "name"])


@query("sink_results", f"SELECT doc_id, fold, CAST(y AS INT) AS y, {sql_r6('pred')} AS pred FROM ({OOF_SQL.format(lines=LINES)}) o UNION ALL SELECT NULL, -1, NULL, {sql_r6('score')} FROM ({best_sql(LINE_GRID, f'({OOF_SQL.format(lines=LINES)})')}) b")
def sink_results(spark, sf_dir):
    """The result tables of a fit, written and read back: all scores, and the best kappa."""
    root = fresh_path(spark, "results")
    made = training.fit_round(LINE, line_table(spark, sf_dir), LINE_ROLES)[1]
    tables.sink_results(made, root)
    read = store.read_results(spark, root, ["oof", "thresholds"])
    scores = read["oof"].select("doc_id", "fold", "y", r6(PRED).alias("pred"))
    best = read["thresholds"].select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(-1).alias("fold"),
        F.lit(None).cast("int").alias("y"), r6("score").alias("pred"),
    )
    return scores.unionByName(best)


@query("publish_results", f"SELECT doc_id, fold, CAST(y AS INT) AS y, {sql_r6('pred')} AS pred FROM ({OOF_SQL.format(lines=LINES)}) o")
def publish_results(spark, sf_dir):
    """The scores of a fit among its result tables, replaced at once and read back."""
    root = fresh_path(spark, "results")
    made = training.fit_round(LINE, line_table(spark, sf_dir), LINE_ROLES)[1]
    tables.publish_results({name: df.limit(0) for name, df in made.items()}, root)
    tables.publish_results(made, root)
    return store.read_results(spark, root, ["oof"])["oof"].select("doc_id", "fold", "y", r6(PRED).alias("pred"))


MEAN_LINE = f"(SELECT doc_id, sum(slope * n_chars / 1e3 + intercept) / 5 AS pred FROM documents, ({LINES}) f GROUP BY doc_id)"
LINE_CUTS = (0.9, 1.6, 1.9)


@query("submission_fitted", f"SELECT doc_id, CAST({class_sql('pred', LINE_CUTS)} AS INT) AS y FROM {MEAN_LINE} m")
def submission_fitted(spark, sf_dir):
    """Fitted lines stored, loaded in their place and scored into a submission."""
    fitted_lines = models.cv_fit(line_table(spark, sf_dir), ["length"], [], "y", models.linear(), N_FOLD)
    path = fresh_path(spark, "line-member")
    store.save_member(pseudo.Round("main", fitted_lines, {"t1": 0.9}), path)
    loaded = store.load_member(spark, path)
    test = I.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("length"))
    out = fresh_path(spark, "submission")
    done = inference.submit({"line": loaded.models}, test, LINE_ROLES, out, LINE_CUTS)
    return done.select("doc_id", "y")


@query("stored_member", f"SELECT id, 0e0 AS gap FROM {GOLD_IDS} g")
def stored_member(spark, sf_dir):
    """Stored validation scores of the forest against those of the loaded models."""
    root = stored(spark, sf_dir, "forest")
    before = store.read_results(spark, f"{root}/results")["oof"].select("id", F.col(PRED).alias("before"))
    now = models.oof_predict(fitted(spark, sf_dir, "forest").models, gold(spark, sf_dir), keep=["id"])
    return before.join(now, "id").select("id", r6(F.abs(F.col(PRED) - F.col("before"))).alias("gap"))


def both_members(spark, sf_dir) -> dict[str, list[FoldModel]]:
    return {n: fitted(spark, sf_dir, n).models for n in ("boosted", "forest")}


@query("ensemble_oof_trees", "SELECT CAST(1 AS BIGINT) AS n, 0e0 AS gap")
def ensemble_oof_trees(spark, sf_dir):
    """Best thresholds for the blend of both tree members: the score that the search
    reports against the kappa of the blended scores under these thresholds."""
    members, rows = both_members(spark, sf_dir), gold(spark, sf_dir)
    best = inference.search_blend(members, rows, ROLES).first()
    keyed = models.union_all([models.oof_predict(m, rows, keep=["id", TARGET]) for m in members.values()])
    blended = ensemble.ensemble_scores(keyed, len(members), ["id", "fold", TARGET])
    cuts = [best["t1"], best["t2"], best["t3"]]
    direct = metrics.qwk_threshold(blended, TARGET, PRED, cuts, ["fold"])
    return direct.agg(
        F.lit(1).cast("bigint").alias("n"), r6(F.abs(F.avg("qwk") - F.lit(best["score"]))).alias("gap")
    )


@query("submission", f"SELECT id, true AS valid FROM {I.subjects_sql()} s")
def submission(spark, sf_dir):
    """Classes of all test rows, written and read back, against the mean of all folds' scores."""
    found = fitted(spark, sf_dir).best
    cuts = [found["t1"], found["t2"], found["t3"]]
    members, rows = both_members(spark, sf_dir), test_features(spark, sf_dir)
    done = inference.submit(members, rows, ROLES, fresh_path(spark, "submission"), cuts)
    preds = models.predict_members(members, rows, "id")
    direct = ensemble.ensemble_predict(preds, len(members), N_FOLD, cuts, "id")
    return done.join(direct, "id").select("id", (F.col(TARGET) == F.col("class")).alias("valid"))
