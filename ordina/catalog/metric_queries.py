"""Queries on kappa, threshold search, blends, curves and pseudo-labels.

Scores here are formulas over the documents, so SQL can state every result. The
fitted models are in `model_queries`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.catalog import inputs as I
from ordina.catalog.inputs import r6, rounded, sql_r6
from ordina.catalog.registry import query
from ordina.config import BASE_THRESHOLDS
from ordina.functions import classes as fc
from ordina.operators import ensemble, explain, metrics, models, pseudo, thresholds
from ordina.operators.models import ExpressionModel
from ordina.session import fresh_path
from ordina.sources import tables

SCORED = I.scored_sql()
PREDS = I.predictions_sql()
N_MODELS = len(I.SCORES)
N_FOLD = 5


def class_sql(pred: str, cuts=BASE_THRESHOLDS) -> str:
    arms = " ".join(f"WHEN {pred} < {t!r}e0 THEN {i}" for i, t in enumerate(cuts))
    return f"CASE {arms} ELSE {len(cuts)} END"


def kappa_sql(source: str, y: str, p: str, by: str) -> str:
    """Kappa per group from the counts of label pairs, positions by rank."""
    return f"""(
      WITH pairs AS (SELECT {by}, {y} AS y, {p} AS p, count(*) AS n FROM {source} s GROUP BY 1, 2, 3),
      labels AS (SELECT {by}, y AS label FROM pairs UNION SELECT {by}, p FROM pairs),
      placed AS (SELECT {by}, label, row_number() OVER (PARTITION BY {by} ORDER BY label) - 1 AS pos
                 FROM labels),
      cells AS (SELECT pairs.{by}, n, a.pos AS t, b.pos AS p FROM pairs
                JOIN placed a ON a.{by} = pairs.{by} AND a.label = pairs.y
                JOIN placed b ON b.{by} = pairs.{by} AND b.label = pairs.p),
      sums AS (SELECT {by}, CAST(sum(n) AS DOUBLE) AS n, sum(n * t) AS t, sum(n * p) AS p,
                      sum(n * (t - p) * (t - p)) AS observed, sum(n * t * t) + sum(n * p * p) AS squares
               FROM cells GROUP BY {by})
      SELECT {by}, 1 - observed / nullif(squares - 2 * t * p / n, 0) AS qwk FROM sums
    )"""


def kappa_out(source: str, by: str) -> str:
    return f"SELECT {by}, {sql_r6('qwk')} AS qwk FROM {source} k"


def keyed(df: DataFrame) -> DataFrame:
    return rounded(df, ["fold"])


# --- classes -----------------------------------------------------------------


@query("round_to_class", f"SELECT id, CAST({class_sql('pred_0')} AS INT) AS class FROM {SCORED} s")
def round_to_class(spark, sf_dir):
    return I.scored(spark, sf_dir).select(
        "id", fc.round_to_class("pred_0", BASE_THRESHOLDS).alias("class")
    )


@query("ordinal_target", f"SELECT id, {', '.join(f'CAST(y >= {i} AS DOUBLE) AS o{i}' for i in range(4))} FROM {SCORED} s")
def ordinal_target(spark, sf_dir):
    vector = I.scored(spark, sf_dir).select("id", fc.ordinal_target("y", 4).alias("o"))
    return vector.select("id", *[F.get("o", F.lit(i)).alias(f"o{i}") for i in range(4)])


ORDINAL_SQL = "CASE WHEN pred_0 / 3 > 0.5 THEN 3 WHEN pred_2 / 3 > 0.5 THEN 2 WHEN pred_1 / 3 > 0.5 THEN 1 ELSE 0 END"


def ordinal_scores(spark, sf_dir) -> DataFrame:
    parts = [F.lit(1.0), F.col("pred_1") / 3, F.col("pred_2") / 3, F.col("pred_0") / 3]
    return I.scored(spark, sf_dir).select(
        "id", "fold", "y", fc.ordinal_target("y", 4).alias("target"), F.array(*parts).alias("p")
    )


@query("ordinal_decode", f"SELECT id, CAST({ORDINAL_SQL} AS INT) AS class FROM {SCORED} s")
def ordinal_decode(spark, sf_dir):
    return ordinal_scores(spark, sf_dir).select("id", fc.ordinal_decode("p").alias("class"))


# --- kappa -------------------------------------------------------------------


@query("qwk", kappa_out(kappa_sql(SCORED, "y", "CAST(id % 3 AS INT)", "fold"), "fold"))
def qwk(spark, sf_dir):
    """Labels that do not all occur: the prediction never reaches the top class."""
    rows = I.scored(spark, sf_dir)
    return keyed(metrics.qwk(rows, F.col("y"), (F.col("id") % 3).cast("int"), ["fold"]))


@query("qwk_threshold", kappa_out(kappa_sql(SCORED, "y", class_sql("pred_0"), "fold"), "fold"))
def qwk_threshold(spark, sf_dir):
    rows = I.scored(spark, sf_dir)
    return keyed(metrics.qwk_threshold(rows, "y", "pred_0", BASE_THRESHOLDS, ["fold"]))


@query("qwk_round", kappa_out(kappa_sql(SCORED, "y", "CAST(round_even(pred_1, 0) AS INT)", "fold"), "fold"))
def qwk_round(spark, sf_dir):
    return keyed(metrics.qwk_round(I.scored(spark, sf_dir), "y", "pred_1", ["fold"]))


@query("qwk_ordinal", kappa_out(kappa_sql(SCORED, "y", ORDINAL_SQL, "fold"), "fold"))
def qwk_ordinal(spark, sf_dir):
    return keyed(metrics.qwk_ordinal(ordinal_scores(spark, sf_dir), "target", "p", ["fold"]))


# --- threshold search --------------------------------------------------------


def axis_sql(grid: thresholds.ThresholdGrid, i: int) -> str:
    values = ", ".join(f"({n}, {v!r}e0)" for n, v in enumerate(grid.axes[i]))
    return f"(VALUES {values}) a{i}(j{i}, t{i + 1})"


def grid_sql(grid: thresholds.ThresholdGrid) -> str:
    sizes = [len(a) for a in grid.axes]
    combo = f"(j0 * {sizes[1]} + j1) * {sizes[2]} + j2"
    rising = " WHERE t1 < t2 AND t2 < t3" if grid.rising else ""
    text = (
        f"SELECT CAST({combo} AS BIGINT) AS combo, t1, t2, t3"
        f" FROM {axis_sql(grid, 0)}, {axis_sql(grid, 1)}, {axis_sql(grid, 2)}{rising}"
    )
    if grid.base:
        base = ", ".join(f"{t!r}e0" for t in grid.base)
        text += f" UNION ALL SELECT {sizes[0] * sizes[1] * sizes[2]}, {base}"
    return f"({text})"


def _joined_sql(parts) -> str:
    return " + ".join(parts)


def scores_sql(grid: thresholds.ThresholdGrid, source: str) -> str:
    """Mean kappa of every tuple, from per-threshold counts per fold and label.

    A label that is on neither side takes no position, as in `kappa_sql`.
    """
    four = range(4)
    at_least = ", ".join(
        f"count(*) FILTER (WHERE pred >= t AND y = {i}) AS g{i}" for i in four
    )
    total = ", ".join(f"count(*) FILTER (WHERE y = {i}) AS a{i}" for i in four)
    steps = {i: [f"base.a{i}", f"a.g{i}", f"b.g{i}", f"d.g{i}", "0"] for i in four}
    cells = ", ".join(
        f"{steps[i][j]} - {steps[i][j + 1]} AS c{i}{j}" for i in four for j in four
    )
    rows = ", ".join(f"{_joined_sql(f'c{i}{j}' for j in four)} AS r{i}" for i in four)
    cols = ", ".join(f"{_joined_sql(f'c{i}{j}' for i in four)} AS q{j}" for j in four)
    present = [f"CAST(r{i} + q{i} > 0 AS INT)" for i in four]
    places = ", ".join(f"{_joined_sql(['0', *present[:i]])} AS p{i}" for i in four)
    moments = {
        "n": _joined_sql(f"r{i}" for i in four),
        "t": _joined_sql(f"p{i} * r{i}" for i in four),
        "p": _joined_sql(f"p{i} * q{i}" for i in four),
        "squares": _joined_sql(f"p{i} * p{i} * (r{i} + q{i})" for i in four),
        "tp": _joined_sql(f"p{i} * p{j} * c{i}{j}" for i in four for j in four),
    }
    sums = ", ".join(f"CAST({e} AS DOUBLE) AS {m}" for m, e in moments.items())
    kappa = "1 - (squares - 2 * tp) / nullif(squares - 2 * t * p / n, 0)"
    return f"""(
      WITH rows AS (SELECT fold, y, pred FROM {source} r),
      grid AS {grid_sql(grid)},
      cuts AS (SELECT DISTINCT t FROM (SELECT t1 AS t FROM grid UNION ALL SELECT t2 FROM grid
                                       UNION ALL SELECT t3 FROM grid) u),
      counts AS (SELECT fold, t, {at_least} FROM rows, cuts GROUP BY fold, t),
      base AS (SELECT fold, {total} FROM rows GROUP BY fold),
      cells AS (SELECT combo, t1, t2, t3, {cells}
                FROM grid JOIN counts a ON a.t = t1
                JOIN counts b ON b.t = t2 AND b.fold = a.fold
                JOIN counts d ON d.t = t3 AND d.fold = a.fold
                JOIN base ON base.fold = a.fold),
      margins AS (SELECT *, {rows}, {cols} FROM cells),
      placed AS (SELECT *, {places} FROM margins),
      sums AS (SELECT combo, t1, t2, t3, {sums} FROM placed)
      SELECT combo, t1, t2, t3, CASE WHEN count({kappa}) = count(*) THEN avg({kappa}) END AS score
      FROM sums GROUP BY combo, t1, t2, t3
    )"""


def best_sql(grid: thresholds.ThresholdGrid, source: str, digits: int = 9) -> str:
    return (
        f"SELECT * FROM {scores_sql(grid, source)} x"
        f" ORDER BY round(score, {digits}) DESC NULLS LAST, combo LIMIT 1"
    )


ONE_MODEL = f"(SELECT fold, y, pred_1 AS pred FROM {SCORED} s)"
TUPLE = ["combo", "t1", "t2", "t3"]
GRID = thresholds.grid_cross()
RISING = thresholds.grid_combinations(0.0, 3.0)
FINE = ensemble.ensemble_grid()


def out_tuple(source: str, extra: str = "") -> str:
    return f"SELECT combo, {', '.join(f'{sql_r6(t)} AS {t}' for t in TUPLE[1:])}, {sql_r6('score')} AS score{extra} FROM ({source}) b"


@query("threshold_grid", out_tuple(f"SELECT * FROM {scores_sql(GRID, ONE_MODEL)} x"))
def threshold_grid(spark, sf_dir):
    """Every tuple of the 25-point grid with its mean kappa over the folds."""
    scores = thresholds.grid_scores(I.scored(spark, sf_dir), "fold", "y", "pred_1", GRID)
    return rounded(scores, ["combo"])


def sizes_sql(grid: thresholds.ThresholdGrid) -> str:
    return f"""
      WITH rows AS (SELECT pred FROM {ONE_MODEL} r),
      grid AS {grid_sql(grid)},
      cuts AS (SELECT DISTINCT t FROM (SELECT t1 AS t FROM grid UNION ALL SELECT t2 FROM grid
                                       UNION ALL SELECT t3 FROM grid) u),
      counts AS (SELECT t, count(*) FILTER (WHERE pred >= t) AS c FROM rows, cuts GROUP BY t)
      SELECT combo, (SELECT count(*) FROM rows) - a.c AS n_0, a.c - b.c AS n_1, b.c - d.c AS n_2,
             d.c AS n_3
      FROM grid JOIN counts a ON a.t = t1 JOIN counts b ON b.t = t2 JOIN counts d ON d.t = t3"""


def class_sizes(rows: DataFrame, grid: thresholds.ThresholdGrid) -> DataFrame:
    """Rows per class that each tuple of a grid makes."""
    cells = thresholds.grid_cells(rows, "fold", "y", "pred_1", grid)
    n = len(grid.axes) + 1
    per_class = [
        F.sum(sum((F.col(metrics.CELLS.format(i, j)) for i in range(n)), F.lit(0))).alias(f"n_{j}")
        for j in range(n)
    ]
    return cells.groupBy("combo").agg(*per_class)


@query("grid_cross", sizes_sql(GRID))
def grid_cross(spark, sf_dir):
    return class_sizes(I.scored(spark, sf_dir), GRID)


@query("grid_combinations", sizes_sql(RISING))
def grid_combinations(spark, sf_dir):
    return class_sizes(I.scored(spark, sf_dir), RISING)


CUTS = [0.25, 0.5, 1.0, 1.5, 2.0, 2.75]


@query("pred_ge_threshold", f"SELECT fold, {sql_r6('t')} AS threshold, {', '.join(f'count(*) FILTER (WHERE y = {i} AND pred_1 >= t) AS ge_{i}, count(*) FILTER (WHERE y = {i}) AS all_{i}' for i in range(4))} FROM {SCORED} s, (VALUES {', '.join(f'({t!r}e0)' for t in CUTS)}) c(t) GROUP BY fold, t")
def pred_ge_threshold(spark, sf_dir):
    counts = thresholds.pred_ge_threshold(I.scored(spark, sf_dir), "fold", "y", "pred_1", CUTS, 4)
    return counts.drop("at").withColumn("threshold", r6("threshold"))


@query("threshold_search", out_tuple(best_sql(GRID, ONE_MODEL)))
def threshold_search(spark, sf_dir):
    best = thresholds.threshold_search(I.scored(spark, sf_dir), "fold", "y", "pred_1", GRID, 9)
    return rounded(best, ["combo"])


@query("threshold_search_rising", out_tuple(best_sql(RISING, ONE_MODEL)))
def threshold_search_rising(spark, sf_dir):
    """Search over all rising tuples, the grid used when no base is known."""
    best = thresholds.threshold_search(I.scored(spark, sf_dir), "fold", "y", "pred_1", RISING, 9)
    return rounded(best, ["combo"])


@query("argmax_thresholds", out_tuple(best_sql(GRID, f"(SELECT fold, y, pred_2 AS pred FROM {SCORED} s)")))
def argmax_thresholds(spark, sf_dir):
    scores = thresholds.grid_scores(I.scored(spark, sf_dir), "fold", "y", "pred_2", GRID)
    return rounded(thresholds.argmax_thresholds(scores, 9), ["combo"])


BASE_KAPPA = kappa_sql(SCORED, "y", class_sql("pred_1"), "fold")


@query("threshold_gain", out_tuple(best_sql(GRID, ONE_MODEL), f", {sql_r6(f'score - (SELECT avg(qwk) FROM {BASE_KAPPA} k)')} AS gain"))
def threshold_gain(spark, sf_dir):
    rows = I.scored(spark, sf_dir)
    per_fold = metrics.qwk_threshold(rows, "y", "pred_1", BASE_THRESHOLDS, ["fold"])
    base = per_fold.agg(F.avg("qwk")).first()[0]
    best = thresholds.threshold_search(rows, "fold", "y", "pred_1", GRID, 9)
    return rounded(thresholds.threshold_gain(best, base), ["combo"])


# --- blends ------------------------------------------------------------------


def all_folds(spark, sf_dir) -> DataFrame:
    """Every document scored by five fold models: `(id, fold, model, pred)`."""
    return models.predict_folds(formula_models(), I.documents(spark, sf_dir), "doc_id", "main")


def formula_models() -> list[ExpressionModel]:
    return [ExpressionModel(k, F.expr(fold_score_sql(k))) for k in range(N_FOLD)]


def fold_score_sql(k: int) -> str:
    return f"((doc_id * {7 + 2 * k} + n_chars * {k + 1}) % {40 + k}) / {40 + k}e0 * 3e0"


BLEND = " + ".join(f"{fold_score_sql(k)} / {N_FOLD}e0" for k in range(N_FOLD))


@query("blend_folds", f"SELECT doc_id, {sql_r6(BLEND)} AS pred FROM documents")
def blend_folds(spark, sf_dir):
    blended = models.blend_folds(all_folds(spark, sf_dir), "doc_id", N_FOLD)
    return rounded(blended, ["doc_id"])


@query("blend_score", f"SELECT doc_id, {sql_r6(BLEND)} AS pred FROM documents")
def blend_score(spark, sf_dir):
    """The same blend without a shuffle."""
    blended = models.blend_score(formula_models(), I.documents(spark, sf_dir))
    return rounded(blended.select("doc_id", "pred"), ["doc_id"])


@query("threshold_predict", f"SELECT doc_id, CAST({class_sql(f'({BLEND})', (0.9, 1.4, 1.9))} AS INT) AS class FROM documents")
def threshold_predict(spark, sf_dir):
    blended = models.blend_score(formula_models(), I.documents(spark, sf_dir))
    return models.threshold_predict(blended, (0.9, 1.4, 1.9)).select("doc_id", "class")


@query("sink_submission", f"SELECT doc_id, {sql_r6(BLEND)} AS sii FROM documents")
def sink_submission(spark, sf_dir):
    """A raw submission written and read back."""
    path = fresh_path(spark, "submission")
    blended = models.blend_score(formula_models(), I.documents(spark, sf_dir))
    tables.sink_submission(blended, path, "doc_id", "pred", "sii")
    return rounded(spark.read.parquet(path), ["doc_id"])


BLENDED = f"(SELECT id, fold, y, sum(pred / {N_MODELS}e0) AS pred FROM {PREDS} p GROUP BY id, fold, y)"


@query("ensemble_scores", f"SELECT id, fold, y, {sql_r6('pred')} AS pred FROM {BLENDED} b")
def ensemble_scores(spark, sf_dir):
    preds = I.predictions(spark, sf_dir)
    blended = ensemble.ensemble_scores(preds, N_MODELS, ["id", "fold", "y"])
    return rounded(blended, ["id", "fold", "y"])


@query("ensemble_oof", out_tuple(best_sql(FINE, BLENDED)))
def ensemble_oof(spark, sf_dir):
    """Best of 125 001 tuples for the blend of three models."""
    preds = I.predictions(spark, sf_dir)
    return rounded(ensemble.ensemble_oof(preds, "y", N_MODELS, digits=9), ["combo"])


ENSEMBLE_CUTS = (0.7, 1.2, 1.7)
MEMBER_PREDS = " UNION ALL ".join(
    f"SELECT doc_id, {fold_score_sql(k)} + {m}e-1 AS pred FROM documents"
    for k in range(N_FOLD)
    for m in range(2)
)


@query("ensemble_predict", f"SELECT doc_id, {sql_r6('pred')} AS pred, CAST({class_sql('pred', ENSEMBLE_CUTS)} AS INT) AS class FROM (SELECT doc_id, sum(pred / 5e0 / 2e0) AS pred FROM ({MEMBER_PREDS}) p GROUP BY doc_id) b")
def ensemble_predict(spark, sf_dir):
    docs = I.documents(spark, sf_dir)
    members = {
        f"m{m}": [ExpressionModel(k, F.expr(f"{fold_score_sql(k)} + {m}e-1")) for k in range(N_FOLD)]
        for m in range(2)
    }
    preds = models.predict_members(members, docs, "doc_id")
    done = ensemble.ensemble_predict(preds, 2, N_FOLD, ENSEMBLE_CUTS, "doc_id")
    return done.select("doc_id", r6("pred").alias("pred"), "class")


# --- pseudo-labels -----------------------------------------------------------

INFO = "concat_ws(', ', {flags})"


def _info_sql() -> str:
    flags = ", ".join(f"CASE WHEN doc_id % 5 = {k} THEN 'v' ELSE 't' END" for k in range(N_FOLD))
    return INFO.format(flags=flags)


DOC_COLUMNS = ["doc_id", "lang", "source", "n_chars", "y", "fold_info"]
LABELLED_SQL = f"(SELECT *, {_info_sql()} AS fold_info FROM {I.DOCUMENTS_SQL} d WHERE y IS NOT NULL)"


def labelled_docs(spark, sf_dir) -> DataFrame:
    docs = I.documents(spark, sf_dir).where(F.col("y").isNotNull())
    return docs.withColumn("fold_info", F.expr(_info_sql()))


def unlabelled_docs(spark, sf_dir) -> DataFrame:
    return I.documents(spark, sf_dir).where(F.col("y").isNull())


def _pseudo_part(source: str) -> list[str]:
    return [
        f"SELECT doc_id, lang, source, n_chars, {sql_r6(fold_score_sql(k))} AS y,"
        f" '{fc.pseudo_fold_info(k, N_FOLD)}' AS fold_info FROM {source} u"
        for k in range(N_FOLD)
    ]


UNLABELLED_SQL = f"(SELECT * FROM {I.DOCUMENTS_SQL} d WHERE y IS NULL)"
BASE_PART = f"SELECT {', '.join(DOC_COLUMNS[:4])}, CAST(y AS DOUBLE) AS y, fold_info FROM {LABELLED_SQL} l"
PSEUDO = " UNION ALL ".join([BASE_PART, *_pseudo_part(UNLABELLED_SQL)])


@query("pseudo_label", PSEUDO)
def pseudo_label(spark, sf_dir):
    data = pseudo.pseudo_label(
        formula_models(), labelled_docs(spark, sf_dir), unlabelled_docs(spark, sf_dir), "y"
    )
    return data.select(*DOC_COLUMNS).withColumn("y", r6("y"))


@query("pseudo_set", PSEUDO)
def pseudo_set(spark, sf_dir):
    """The same rows from the tables and the stored scores of the unlabelled documents."""
    path, rest = fresh_path(spark, "scores"), unlabelled_docs(spark, sf_dir)
    tables.sink_pseudo(pseudo.pseudo_scores(formula_models(), rest, "doc_id"), path)
    data = pseudo.pseudo_set(labelled_docs(spark, sf_dir), rest, tables.scan_gold(spark, path), "doc_id", "y")
    return data.select(*DOC_COLUMNS).withColumn("y", r6("y"))


@query("sink_pseudo", PSEUDO)
def sink_pseudo(spark, sf_dir):
    path = fresh_path(spark, "pseudo")
    tables.sink_pseudo(pseudo_label(spark, sf_dir), path)
    return tables.scan_gold(spark, path).select(*DOC_COLUMNS)


ONLINE_COLUMNS = ["doc_id", "lang", "n_chars", "y", "fold_info"]


@query("pseudo_label_online", f"SELECT {', '.join(ONLINE_COLUMNS)} FROM ({' UNION ALL '.join([PSEUDO, *_pseudo_part('documents')])}) o")
def pseudo_label_online(spark, sf_dir):
    """With test rows too: all parts are cut to the columns of the test table."""
    test = I.documents(spark, sf_dir).select("doc_id", "lang", "n_chars")
    data = pseudo.pseudo_label(
        formula_models(), labelled_docs(spark, sf_dir), unlabelled_docs(spark, sf_dir), "y", test
    )
    return data.select(*ONLINE_COLUMNS).withColumn("y", r6("y"))


@query("oof_predict", "SELECT doc_id, fold, " + sql_r6("CASE fold " + " ".join(f"WHEN {k} THEN {fold_score_sql(k)}" for k in range(N_FOLD)) + " END") + f" AS pred FROM (SELECT *, CAST(doc_id % 5 AS INT) AS fold FROM {LABELLED_SQL} l) x")
def oof_predict(spark, sf_dir):
    scored = models.oof_predict(formula_models(), labelled_docs(spark, sf_dir))
    return scored.select("doc_id", "fold", r6("pred").alias("pred"))


# --- curves ------------------------------------------------------------------

# One metric value per fold and iteration, from the totals of the orders.
CURVE_SQL = f"""(
  SELECT model, CAST(o_orderkey % 5 AS INT) AS fold, CAST(o_orderkey // 5 % 40 AS INT) AS iter,
         metric, CASE metric WHEN 'q_kappa' THEN avg(o_totalprice) ELSE max(o_totalprice) END / 1e6
         * CASE model WHEN 'main' THEN 1 ELSE CAST(1 + o_orderkey // 5 % 40 AS DOUBLE) / 40 END AS value
  FROM orders, (VALUES ('main'), ('other')) m(model), (VALUES ('q_kappa'), ('rmse')) k(metric)
  GROUP BY 1, 2, 3, 4, o_orderkey // 5 % 40
)"""


def curve(spark, sf_dir) -> DataFrame:
    """Two models: the second one's values rise with the iteration."""
    grouped = (
        I.table(spark, sf_dir, "orders")
        .groupBy(
            (F.col("o_orderkey") % 5).cast("int").alias("fold"),
            F.expr("CAST(o_orderkey div 5 % 40 AS INT)").alias("iter"),
        )
        .agg(
            (F.avg("o_totalprice") / 1e6).alias("q_kappa"),
            (F.max("o_totalprice") / 1e6).alias("rmse"),
        )
    )
    long = grouped.unpivot(["fold", "iter"], ["q_kappa", "rmse"], "metric", "value")
    scale = {"main": F.lit(1.0), "other": (F.col("iter") + 1) / F.lit(40.0)}
    each = F.array(
        *[F.struct(F.lit(m).alias("model"), (F.col("value") * x).alias("value")) for m, x in scale.items()]
    )
    return long.select("fold", "iter", "metric", F.inline(each)).select(
        "model", "fold", "iter", "metric", "value"
    )


CURVE_KEYS = ["model", "metric", "iter"]
MEAN_SQL = f"(SELECT model, metric, iter, avg(value) AS mean, stddev_pop(value) AS std FROM {CURVE_SQL} c GROUP BY 1, 2, 3)"


@query("curve_mean_std", f"SELECT model, metric, iter, {sql_r6('mean')} AS mean, {sql_r6('std')} AS std FROM {MEAN_SQL} m")
def curve_mean_std(spark, sf_dir):
    return rounded(models.curve_mean_std(curve(spark, sf_dir)), CURVE_KEYS)


BEST_ITER = f"(SELECT * FROM {MEAN_SQL} m WHERE metric = 'q_kappa' QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(mean, 9) DESC, iter) = 1)"


@query("argmax_iteration", f"SELECT model, metric, iter, {sql_r6('mean')} AS mean, {sql_r6('std')} AS std FROM {BEST_ITER} b")
def argmax_iteration(spark, sf_dir):
    summary = models.curve_mean_std(curve(spark, sf_dir))
    best = models.argmax_iteration(summary.where(F.col("metric") == "q_kappa"), digits=9)
    return rounded(best, CURVE_KEYS)


@query("best_iteration", f"SELECT m.model, m.iter + 1 AS best_iter, m.metric, {sql_r6('m.mean')} AS mean, {sql_r6('m.std')} AS std FROM {MEAN_SQL} m JOIN {BEST_ITER} b ON b.iter = m.iter AND b.model = m.model")
def best_iteration(spark, sf_dir):
    best = models.best_iteration(curve(spark, sf_dir), digits=9)
    return rounded(best, ["model", "best_iter", "metric"])


@query("melt_curve", f"SELECT fold, iter, metric, {sql_r6('value')} AS value FROM {CURVE_SQL} c WHERE metric = 'q_kappa' AND model = 'main'")
def melt_curve(spark, sf_dir):
    """One column per fold turned into rows."""
    kappa = curve(spark, sf_dir).where("metric = 'q_kappa' AND model = 'main'")
    wide = kappa.groupBy("iter").pivot("fold", list(range(N_FOLD))).agg(F.first("value"))
    wide = wide.select("iter", *[F.col(str(k)).alias(f"fold_{k}") for k in range(N_FOLD)])
    long = models.melt_curve(wide, "q_kappa", N_FOLD).where(F.col("value").isNotNull())
    return rounded(long, ["fold", "iter", "metric"])


@query("argmax_round", f"SELECT round, name, {sql_r6('score')} AS score FROM (SELECT CAST(doc_id % 5 AS INT) AS round, 'main_' || CAST(doc_id % 5 AS VARCHAR) AS name, avg(n_chars) AS score FROM documents GROUP BY 1, 2) r ORDER BY round(score, 6) DESC, round LIMIT 1")
def argmax_round(spark, sf_dir):
    number = (F.col("doc_id") % 5).cast("int")
    scores = (
        I.table(spark, sf_dir, "documents")
        .groupBy(number.alias("round"))
        .agg(F.avg("n_chars").alias("score"))
        .withColumn("name", F.concat(F.lit("main_"), F.col("round").cast("string")))
    )
    return rounded(pseudo.argmax_round(scores, 6), ["round", "name"])


# --- importance tables -------------------------------------------------------

# One importance per fold and brand, from the parts and their line items.
BY_BRAND = "(SELECT CAST(l_orderkey % 5 AS INT) AS fold, p_brand AS feature, avg(l_quantity) AS importance FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def by_brand(spark, sf_dir) -> DataFrame:
    lines, part = I.table(spark, sf_dir, "lineitem"), I.table(spark, sf_dir, "part")
    return (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy((F.col("l_orderkey") % 5).cast("int").alias("fold"), F.col("p_brand").alias("feature"))
        .agg(F.avg("l_quantity").alias("importance"))
    )


@query("importance_mean", f"SELECT feature, {sql_r6('avg(importance)')} AS importance FROM {BY_BRAND} b GROUP BY feature")
def importance_mean(spark, sf_dir):
    return rounded(explain.importance_mean(by_brand(spark, sf_dir)), ["feature"])


@query("rank_features", f"SELECT feature, {sql_r6('avg(importance)')} AS importance FROM {BY_BRAND} b GROUP BY feature ORDER BY avg(importance) DESC, feature LIMIT 5")
def rank_features(spark, sf_dir):
    table = explain.importance_mean(by_brand(spark, sf_dir))
    return rounded(explain.rank_features(table, "importance", 5), ["feature"])


PERMUTED = ["a", "b"]


def _perm_sql(repeats: int = 3, seed: int = 0) -> str:
    source = f"(SELECT id, fold, y, id % 7 * 5e-1 AS a, (id * 3) % 11 * 2e-1 AS b FROM {SCORED} s)"
    parts = []
    for r in range(repeats):
        ranks = "row_number() OVER (PARTITION BY fold ORDER BY md5('{key}' || id), id) AS rn"
        parts.append(
            f"SELECT {r} AS repeat, o.fold, o.y, o.a, o.b, p.a AS pa, p.b AS pb"
            f" FROM (SELECT *, {ranks.format(key=f'{seed}-a-')} FROM {source} s) o"
            f" JOIN (SELECT *, {ranks.format(key=f'{seed}-b{r}-')} FROM {source} s) p"
            " ON o.fold = p.fold AND o.rn = p.rn"
        )
    pairs = " UNION ALL ".join(parts)
    shuffled = (
        f"(SELECT 'a-' || repeat || '-' || fold AS grp, y, {class_sql('(pa + b) / 2')} AS p FROM ({pairs}) x"
        f" UNION ALL SELECT 'b-' || repeat || '-' || fold, y, {class_sql('(a + pb) / 2')} FROM ({pairs}) x)"
    )
    kappas = kappa_sql(shuffled, "y", "p", "grp")
    base = kappa_sql(source, "y", class_sql("(a + b) / 2"), "fold")
    return (
        f"SELECT split_part(grp, '-', 1) AS feature,"
        f" {sql_r6(f'(SELECT avg(qwk) FROM {base} k) - avg(qwk)')} AS importance"
        f" FROM {kappas} k GROUP BY 1"
    )


@query("permutation_importance", _perm_sql())
def permutation_importance(spark, sf_dir):
    """Two columns shuffled in turn under a score that is a formula of both."""
    rows = I.scored(spark, sf_dir).select(
        "id",
        "y",
        (F.col("id") % 7 * F.lit(0.5)).alias("a"),
        ((F.col("id") * 3) % 11 * F.lit(0.2)).alias("b"),
        F.expr(_info_sql().replace("doc_id", "id")).alias("fold_info"),
    )
    formula = [ExpressionModel(k, (F.col("a") + F.col("b")) / 2) for k in range(N_FOLD)]
    table = explain.permutation_importance(formula, rows, "id", "y", PERMUTED)
    return rounded(table, ["feature"])
