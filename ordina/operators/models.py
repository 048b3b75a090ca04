"""Cross-validated fitting and scoring with `pyspark.ml` regressors."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordina.config import BASE_THRESHOLDS
from ordina.functions.classes import fold_entry, round_half_even, round_to_class
from ordina.operators import trees
from ordina.operators.encode import category_rows, fill_none_columns, label_counts
from ordina.operators.metrics import Metric, cell_counts, kappa_of_cells
from ordina.session import LOST_ROWS, fresh_path, kept_rows, shared_dir, written

PRED = "pred"
# Trees take a category's values as bins; more than these are hashed.
MAX_LABELS = 4_096
# Wider aggregates are no longer compiled as a whole.
COLUMNS_AT_ONCE = 32
# A fit keeps twelve bytes for each train row and slot until its last tree: the value and its bin.
FIT_BYTES_AT_ONCE = 3_000_000_000
# Every task of a fit sends the statistics of all slots and bins, however few its rows.
FIT_TASKS_PER_CORE = 3


# --- feature vectors ---------------------------------------------------------


@dataclass(frozen=True)
class FeatureSpace:
    """How the columns of a gold table become one vector without missing values.

    A numeric column is filled with its train mean and, if it had missing train
    values, followed by a 0/1 slot that says so. A code keeps its value as a
    nominal slot; a missing code and one above the train maximum become
    `max + 1`. A text category becomes its position among the train values, of
    which `none` for a missing value is one; an unseen value takes the last slot
    value. A category with more train values than `MAX_LABELS` takes one of as many
    values by its hash.
    """

    fills: dict[str, float]
    flagged: tuple[str, ...]
    top_codes: dict[str, int]
    labels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    hashed: dict[str, int] = field(default_factory=dict)
    train_rows: int = field(default=0, compare=False)

    @property
    def features(self) -> list[str]:
        return [*self.fills, *self.top_codes, *self.labels, *self.hashed]

    @property
    def slot_owners(self) -> list[str]:
        """The feature each vector slot belongs to."""
        return [*self.fills, *self.flagged, *self.top_codes, *self.labels, *self.hashed]

    @property
    def cardinalities(self) -> list[int]:
        """Sizes of the nominal slots, in vector order."""
        return [top + 2 for top in self.top_codes.values()] + [
            len(known) + 1 for known in self.labels.values()
        ] + list(self.hashed.values())

    @property
    def max_cardinality(self) -> int:
        return max(self.cardinalities, default=2)

    @cached_property
    def slot_exprs(self) -> list[str]:
        """SQL of every slot."""
        slots = [f"coalesce({_present_sql(c)}, {float(m)!r}D)" for c, m in self.fills.items()]
        slots += [f"CAST({_present_sql(c)} IS NULL AS DOUBLE)" for c in self.flagged]
        slots += [
            f"CASE WHEN `{c}` BETWEEN 0 AND {top} THEN CAST(`{c}` AS DOUBLE) ELSE {top + 1}D END"
            for c, top in self.top_codes.items()
        ]
        for c, known in self.labels.items():
            texts = ", ".join(_text_literal(v) for v in known)
            value = f"coalesce(CAST(`{c}` AS STRING), 'none')"
            at = f"nullif(array_position(array({texts}), {value}), 0) - 1"
            slots.append(f"CAST(coalesce({at}, {len(known)}) AS DOUBLE)")
        for c, n in self.hashed.items():
            slots.append(f"CAST(pmod(xxhash64(coalesce(CAST(`{c}` AS STRING), 'none')), {n}) AS DOUBLE)")
        return slots

    @cached_property
    def slots_sql(self) -> str:
        """All slots as one array expression, parsed in a single step."""
        return f"array({', '.join(self.slot_exprs)})"

    @cached_property
    def attributes(self) -> dict:
        """ML attributes of the vector: which slots are nominal, and their sizes."""
        first = len(self.fills) + len(self.flagged)
        attrs = {
            "numeric": [{"idx": i, "name": f"slot_{i}"} for i in range(first)],
            "nominal": [
                {"idx": first + i, "name": f"slot_{first + i}", "num_vals": size}
                for i, size in enumerate(self.cardinalities)
            ],
        }
        return {
            "ml_attr": {
                "attrs": {kind: listed for kind, listed in attrs.items() if listed},
                "num_attrs": first + len(self.cardinalities),
            }
        }

    def assemble(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """`df`, or only its columns `keep`, with the vector column `features`."""
        kept = ["*"] if keep is None else [f"`{c}`" for c in keep]
        vector = array_to_vector(F.expr(self.slots_sql))
        return df.select(*kept, vector.alias("features", metadata=self.attributes))


def _present_sql(column: str) -> str:
    """The value as a double, NaN counted as missing."""
    return f"nullif(CAST(`{column}` AS DOUBLE), double('NaN'))"


def _text_literal(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def feature_spaces(
    df: DataFrame,
    numeric: Sequence[str],
    codes: Sequence[str],
    n_fold: int,
    info_col: str = "fold_info",
    as_text: bool = False,
    max_labels: int = MAX_LABELS,
) -> list[FeatureSpace]:
    """The feature space of every fold's train rows, from one pass over the table.

    Sums are grouped by `fold_info`, which has a handful of values, and added up
    per fold from there. With `as_text` the codes are text categories; their labels are
    counted before those of the smaller columns are fetched.
    """
    spaces = _numeric_spaces(df, numeric, () if as_text else codes, n_fold, info_col)
    if not as_text or not codes:
        return spaces
    rows = written(category_rows(fill_none_columns(df, codes), codes, [info_col]), "labels")
    counts = label_counts(rows)
    hashed = {c: max_labels for c in codes if counts.get(c, 0) > max_labels}
    # At most `max_labels` for each column and `fold_info`.
    labels = rows.where(~F.col("column").isin(list(hashed))).collect()
    out = []
    for k, space in enumerate(spaces):
        known: dict[str, set] = {c: set() for c in codes if c not in hashed}
        for r in labels:
            if r[info_col] and r[info_col].split(", ")[k] == "t":
                known[r["column"]].add(r["value"])
        out.append(replace(space, labels={c: tuple(sorted(v)) for c, v in known.items()}, hashed=hashed))
    return out


def _numeric_spaces(
    df: DataFrame, numeric: Sequence[str], codes: Sequence[str], n_fold: int, info_col: str
) -> list[FeatureSpace]:
    parts = _train_parts(df, numeric, codes, info_col)
    spaces = []
    for k in range(n_fold):
        train = [r for info, r in parts.items() if info and info.split(", ")[k] == "t"]
        rows = sum(r["__rows"] for r in train)
        fills, flagged, tops = {}, [], {}
        for i, c in enumerate(numeric):
            n = sum(r[f"n{i}"] for r in train)
            fills[c] = sum(r[f"s{i}"] or 0.0 for r in train) / n if n else 0.0
            if 0 < n < rows:
                flagged.append(c)
        for i, c in enumerate(codes):
            tops[c] = max((r[f"m{i}"] for r in train if r[f"m{i}"] is not None), default=-1)
        spaces.append(FeatureSpace(fills, tuple(flagged), tops, train_rows=rows))
    return spaces


def _train_parts(df: DataFrame, numeric: Sequence[str], codes: Sequence[str], info_col: str) -> dict[str, dict]:
    """Per `fold_info` its rows, sums, counts and maxima, a few columns at a time."""
    aggs = [
        [F.expr(f"sum({_present_sql(c)}) AS s{i}"), F.expr(f"count({_present_sql(c)}) AS n{i}")]
        for i, c in enumerate(numeric)
    ]
    aggs += [[F.expr(f"CAST(max(`{c}`) AS INT) AS m{i}")] for i, c in enumerate(codes)]
    parts: dict[str, dict] = {}
    for first in range(0, max(1, len(aggs)), COLUMNS_AT_ONCE):
        some = [a for listed in aggs[first : first + COLUMNS_AT_ONCE] for a in listed]
        for r in df.groupBy(info_col).agg(F.count(F.lit(1)).alias("__rows"), *some).collect():
            parts.setdefault(r[info_col], {}).update(r.asDict())
    return parts


# --- fold models -------------------------------------------------------------


@dataclass(frozen=True)
class TreeNodes:
    """One fitted tree as arrays, children by index, leaves with feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left_codes: tuple[frozenset[float] | None, ...]
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @property
    def leaf_values(self) -> list[float]:
        """Leaf values in the order in which Spark numbers the leaves of a tree."""
        return [float(v) for v, f in zip(self.value, self.feature) if f < 0]


@dataclass
class FoldModel:
    """The regressor of one fold with the feature space it was fitted in."""

    fold: int
    space: FeatureSpace
    model: Model
    upto: int | None = None

    @property
    def is_ensemble(self) -> bool:
        return hasattr(self.model, "treeWeights")

    @property
    def averages(self) -> bool:
        """Whether the trees are averaged (a forest) and not added up."""
        return type(self.model).__name__.startswith("RandomForest")

    @cached_property
    def trees(self) -> list[TreeNodes]:
        """The fitted trees; their number and size are bounded by the estimator."""
        if not self.is_ensemble:
            raise TypeError(f"{type(self.model).__name__} has no trees")
        spark = SparkSession.active()
        path = fresh_path(spark, "trees")
        self.model.write().save(path)
        rows = (
            spark.read.parquet(f"{path}/data")
            .select("treeID", "nodeData.*")
            .orderBy("treeID", "id")
            .collect()
        )
        by_tree: dict[int, list] = {}
        for r in rows:
            by_tree.setdefault(r["treeID"], []).append(r)
        return [_tree_nodes(by_tree[t]) for t in sorted(by_tree)]

    @cached_property
    def weights(self) -> list[float]:
        return [float(w) for w in self.model.treeWeights]

    @property
    def n_trees(self) -> int:
        return len(self.weights)

    def cut(self, upto: int) -> FoldModel:
        """The same model using its first `upto` trees only."""
        out = FoldModel(self.fold, self.space, self.model, upto)
        for name in ("trees", "weights"):
            if name in self.__dict__:
                out.__dict__[name] = self.__dict__[name]
        return out

    def score(self, df: DataFrame, out: str = PRED, keep: Sequence[str] | None = None) -> DataFrame:
        """`df`, or its columns `keep`, plus the prediction; no shuffle."""
        keep = [c for c in (df.columns if keep is None else keep) if c != out]
        kept = [f"`{c}`" for c in keep]
        if self.upto is None or not self.is_ensemble:
            wide = self.model.transform(self.space.assemble(df, keep))
            return wide.select(*kept, F.col(self.model.getPredictionCol()).alias(out))
        return df.select(*kept, tree_score(self).alias(out))


def _tree_nodes(rows: list) -> TreeNodes:
    index = {r["id"]: i for i, r in enumerate(rows)}
    feature, threshold, codes = [], [], []
    for r in rows:
        split = r["split"]
        leaf = r["leftChild"] < 0
        nominal = not leaf and split["numCategories"] != -1
        feature.append(-1 if leaf else split["featureIndex"])
        codes.append(frozenset(split["leftCategoriesOrThreshold"]) if nominal else None)
        threshold.append(
            math.nan if leaf or nominal else split["leftCategoriesOrThreshold"][0]
        )
    return TreeNodes(
        np.array(feature),
        np.array(threshold),
        tuple(codes),
        np.array([index.get(r["leftChild"], -1) for r in rows]),
        np.array([index.get(r["rightChild"], -1) for r in rows]),
        np.array([r["prediction"] for r in rows]),
        np.array([r["impurityStats"][0] for r in rows]),
        np.array([r["gain"] for r in rows]),
    )


def tree_score(m) -> Column:
    """Sum or mean of the leaves where a row ends; its tested slots are read once for all trees."""
    slots = ", ".join(m.space.slot_exprs[i] for i in trees.used_slots(m)) or "0D"
    forest = F.get(trees.by_fold([m], trees.forest_entry, trees.FOREST), F.lit(m.fold))
    return trees.bound(
        {"f": forest, "x": F.expr(f"array({slots})")},
        lambda b: trees.summed(trees.leaf_values(b["f"], b["x"])) / F.element_at(b["f"]["divisors"], -1),
    )


@dataclass
class ExpressionModel:
    """A fold model given as a column, for scores that are known as a formula."""

    fold: int
    expression: Column
    upto: int | None = None

    def score(self, df: DataFrame, out: str = PRED, keep: Sequence[str] | None = None) -> DataFrame:
        kept = [f"`{c}`" for c in (df.columns if keep is None else keep) if c != out]
        return df.select(*kept, self.expression.alias(out))


@dataclass
class StatedTrees:
    """A fold model given as trees, for ensembles that do not come from a fit here."""

    fold: int
    space: FeatureSpace
    trees: list[TreeNodes]
    weights: list[float]
    averages: bool = False
    upto: int | None = None
    is_ensemble = True

    @property
    def n_trees(self) -> int:
        return len(self.trees)

    def cut(self, upto: int) -> StatedTrees:
        return replace(self, upto=upto)

    def score(self, df: DataFrame, out: str = PRED, keep: Sequence[str] | None = None) -> DataFrame:
        kept = [f"`{c}`" for c in (df.columns if keep is None else keep) if c != out]
        return df.select(*kept, tree_score(self).alias(out))


def cv_fit(
    df: DataFrame,
    numeric: Sequence[str],
    codes: Sequence[str],
    target: str,
    estimator: Callable[[FeatureSpace], Estimator],
    n_fold: int,
    info_col: str = "fold_info",
    parallelism: int = 4,
    as_text: bool = False,
    max_labels: int = MAX_LABELS,
) -> list[FoldModel]:
    """One regressor per fold, fitted on the fold's train rows.

    Folds are independent Spark jobs, so a few of them are submitted at once, as many
    as `FIT_BYTES_AT_ONCE` has room for. A fit has at most `FIT_TASKS_PER_CORE` tasks a
    core, so that the statistics it shuffles for each tree do not grow with the rows.
    Trees pass over their rows several times before they bin them; the vectors are made
    once and kept for these passes, on disk where memory is short.
    """
    spaces = feature_spaces(df, numeric, codes, n_fold, info_col, as_text, max_labels)
    shared_dir(df.sparkSession)  # boosting checkpoints its residuals there
    tasks = FIT_TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    size = max((12 * s.train_rows * len(s.slot_owners) for s in spaces), default=0)
    parallelism = min(parallelism, n_fold, max(1, FIT_BYTES_AT_ONCE // max(1, size)))

    def fit(k: int) -> FoldModel:
        train = df.where(fold_entry(info_col, k) == "t")
        labelled = train.withColumn("__label", F.col(target).cast("double"))
        rows = spaces[k].assemble(labelled, ["__label"]).coalesce(tasks)
        learner = estimator(spaces[k])
        # Others read their rows once.
        model = _fit_on_kept(learner, rows) if hasattr(learner, "maxBins") else learner.fit(rows)
        return FoldModel(k, spaces[k], model)

    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(fit), range(n_fold))


def _fit_on_kept(learner: Estimator, rows: DataFrame) -> Model:
    """The model of rows that are made once; if an executor takes its part away, of rows made anew."""
    try:
        with kept_rows(rows) as kept:
            return learner.fit(kept)
    except Exception as failed:
        if LOST_ROWS not in str(failed):
            raise
    return learner.fit(rows)


def boosted_trees(iterations: int = 20, depth: int = 3, step: float = 0.1, seed: int = 0):
    """Estimator factory for gradient-boosted trees."""
    from pyspark.ml.regression import GBTRegressor

    return lambda space: GBTRegressor(
        featuresCol="features",
        labelCol="__label",
        maxIter=iterations,
        maxDepth=depth,
        stepSize=step,
        maxBins=max(32, space.max_cardinality),
        seed=seed,
    )


def forest(trees: int = 20, depth: int = 5, seed: int = 0):
    """Estimator factory for a random forest."""
    from pyspark.ml.regression import RandomForestRegressor

    return lambda space: RandomForestRegressor(
        featuresCol="features",
        labelCol="__label",
        numTrees=trees,
        maxDepth=depth,
        maxBins=max(32, space.max_cardinality),
        seed=seed,
    )


def linear(ridge: float = 0.0):
    """Estimator factory for least squares by the normal equations."""
    from pyspark.ml.regression import LinearRegression

    return lambda space: LinearRegression(
        featuresCol="features", labelCol="__label", regParam=ridge, solver="normal"
    )


# --- scoring -----------------------------------------------------------------


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def oof_predict(
    models: Sequence,
    df: DataFrame,
    info_col: str = "fold_info",
    out: str = PRED,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Each fold's validation rows scored by that fold's model, with their `fold`."""
    return union_all(
        [
            m.score(df.where(fold_entry(info_col, m.fold) == "v"), out, keep).withColumn(
                "fold", F.lit(m.fold)
            )
            for m in models
        ]
    )


def score_all(models: Sequence, df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The columns `keep` and one score column per model, from one pass over the rows."""
    names = [f"__pred_{i}" for i in range(len(models))]
    for name, m in zip(names, models):
        df = m.score(df, name)
    return df.select(*[f"`{c}`" for c in keep], *names), names


def predict_members(members: dict[str, Sequence], df: DataFrame, id_col: str) -> DataFrame:
    """`(id, fold, model, pred)`: every row scored by every fold of every member, in one pass."""
    flat = [(name, m) for name, models in members.items() for m in models]
    wide, names = score_all([m for _, m in flat], df, [id_col])
    scores = F.array(
        *[
            F.struct(F.lit(m.fold).alias("fold"), F.lit(name).alias("model"), F.col(c).alias(PRED))
            for (name, m), c in zip(flat, names)
        ]
    )
    return wide.select(id_col, F.inline(scores))


def predict_folds(models: Sequence, df: DataFrame, id_col: str, model: str) -> DataFrame:
    """`(id, fold, model, pred)`: every row scored by every fold's model, in one pass."""
    return predict_members({model: models}, df, id_col)


def blend_folds(preds: DataFrame, id_col: str, n_fold: int, by: Sequence[str] = ()) -> DataFrame:
    """Sum over the folds of `pred / n_fold` from a keyed prediction table."""
    return preds.groupBy(id_col, *by).agg(F.sum(F.col(PRED) / F.lit(float(n_fold))).alias(PRED))


def blend_score(models: Sequence, df: DataFrame, out: str = PRED) -> DataFrame:
    """The same blend computed row by row, without a shuffle."""
    wide, names = score_all(models, df, df.columns)
    total = reduce(lambda a, b: a + b, [F.col(n) / F.lit(float(len(models))) for n in names])
    return wide.withColumn(out, total).drop(*names)


def threshold_predict(
    preds: DataFrame, thresholds: Sequence[float], pred: str = PRED, out: str = "class"
) -> DataFrame:
    return preds.withColumn(out, round_to_class(pred, thresholds))


# --- metric curve ------------------------------------------------------------


def staged_metric(
    models: Sequence,
    df: DataFrame,
    target: str,
    thresholds: Sequence[float] = BASE_THRESHOLDS,
    model: str = "main",
    metric: str = "q_kappa",
    info_col: str = "fold_info",
    metrics: Mapping[str, Metric] | None = None,
) -> DataFrame:
    """`(model, fold, iter, metric, value)`: validation metrics after every tree.

    By default the kappa of `thresholds`, called `metric`. A row only tells where its class
    changes: (iteration, class before, class after). The changes are counted by fold and
    label, and a running sum over the iterations turns them into every confusion matrix.
    `metrics` names others instead; all of them come from one pass, in which the rows'
    scores after every tree meet the partial aggregates.
    """
    if metrics is not None:
        return _staged_metrics(models, df, target, model, info_col, metrics)
    n_classes = len(thresholds) + 1
    events = union_all([_class_changes(g, df, target, thresholds, info_col) for g in trees.node_groups(models)])
    counted = events.groupBy("fold", "y", "iter", "before", "after").agg(F.count(F.lit(1)).alias("n"))
    moves = F.array(
        F.struct(F.col("after").alias("p"), F.col("n").alias("d")),
        F.struct(F.col("before").alias("p"), (-F.col("n")).alias("d")),
    )
    steps = counted.select("fold", "y", "iter", F.inline(moves)).groupBy("fold", "iter")
    steps = steps.agg(*cell_counts(F.col("y"), F.col("p"), n_classes, F.col("d")))
    # One row per fold and tree.
    sizes = df.sparkSession.createDataFrame([(m.fold, m.upto or m.n_trees) for m in models], "fold int, n int")
    grid = sizes.select("fold", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("iter"))
    upto = Window.partitionBy("fold").orderBy("iter").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = [c for c in steps.columns if c not in ("fold", "iter")]
    running = grid.join(steps, ["fold", "iter"], "left").select(
        "fold", "iter", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in cells]
    )
    # A fold without validation rows has no curve.
    seen = reduce(lambda a, b: a + b, [F.col(c) for c in cells])
    return kappa_of_cells(running.where(seen > 0), n_classes, "value").select(
        F.lit(model).alias("model"), "fold", "iter", F.lit(metric).alias("metric"), "value"
    )


def _class_changes(models, df, target, thresholds, info_col) -> DataFrame:
    """(fold, y, iter, before, after) wherever a row's class changes; before the first tree it is -1."""
    n_classes = len(thresholds) + 1
    y = round_half_even(target)
    known = F.raise_error(F.lit("a class lies outside the known range")).cast("int")
    rows = trees.validation_slots(models, df, [target], info_col)
    no_event = F.array().cast("array<struct<iter:int,before:int,after:int>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("s"), F.lit(-1).alias("p"), no_event.alias("e"))

    def events(b: Column) -> Column:
        def add(acc: Column, value: Column) -> Column:
            score = acc["s"] + value
            now = round_to_class(score / F.get(b["f"]["divisors"], acc["i"]), thresholds)
            event = F.struct(acc["i"].alias("iter"), acc["p"].alias("before"), now.alias("after"))
            told = F.when(now == acc["p"], acc["e"]).otherwise(F.concat(acc["e"], F.array(event)))
            return F.struct((acc["i"] + 1).alias("i"), score.alias("s"), now.alias("p"), told.alias("e"))

        return F.aggregate(trees.leaf_values(b["f"], b["x"]), start, add, lambda acc: acc["e"])

    forests = trees.by_fold(models, trees.forest_entry, trees.FOREST)
    told = trees.bound({"f": F.get(forests, F.col("fold")), "x": F.col("__x")}, events)
    label = F.when(y.between(0, n_classes - 1), y).otherwise(known)
    return rows.select("fold", label.alias("y"), F.inline(told))


def staged_scores(models: Sequence, df: DataFrame, keep: Sequence[str], info_col: str = "fold_info") -> DataFrame:
    """`keep`, `fold`, `iter` and the score after that tree, for every validation row."""
    out = []
    for group in trees.node_groups(models):
        forests = trees.by_fold(group, trees.forest_entry, trees.FOREST)

        def scores(b: Column) -> Column:
            def add(acc: Column, value: Column) -> Column:
                before = F.when(F.size(acc) == 0, F.lit(0.0)).otherwise(F.get(acc, F.size(acc) - 1))
                return F.concat(acc, F.array(before + value))

            sums = F.aggregate(trees.leaf_values(b["f"], b["x"]), F.array().cast("array<double>"), add)
            return F.zip_with(sums, b["f"]["divisors"], lambda s, d: s / d)

        rows = trees.validation_slots(group, df, keep, info_col)
        each = trees.bound({"f": F.get(forests, F.col("fold")), "x": F.col("__x")}, scores)
        out.append(rows.select(*[f"`{c}`" for c in keep], "fold", F.posexplode(each).alias("iter", PRED)))
    return union_all(out)


def _staged_metrics(models, df, target, model, info_col, metrics) -> DataFrame:
    y, p = F.col(target).cast("double"), F.col(PRED)
    parts = [F.struct(*how.parts(y, p)).alias(f"__of_{i}") for i, how in enumerate(metrics.values())]
    # One row per fold and iteration, read once for every metric.
    staged = staged_scores(models, df, [target], info_col)
    grouped = written(staged.groupBy("fold", "iter").agg(*parts), "staged")
    done = []
    for i, (name, how) in enumerate(metrics.items()):
        one = how.finish(grouped.select("fold", "iter", f"__of_{i}.*"), "value")
        done.append(
            one.select(F.lit(model).alias("model"), "fold", "iter", F.lit(name).alias("metric"), "value")
        )
    return union_all(done)


def curve_mean_std(curve: DataFrame) -> DataFrame:
    """Mean and population std over the folds for each iteration and metric."""
    return curve.groupBy("model", "metric", "iter").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def argmax_iteration(
    summary: DataFrame, maximize: bool = True, digits: int | None = None
) -> DataFrame:
    """Each model's iteration with the best mean; the first one among equals."""
    mean = F.col("mean") if digits is None else F.round("mean", digits)
    worth = F.coalesce(mean if maximize else -mean, F.lit(float("-inf")))
    best = F.max_by(F.struct(*summary.columns), F.struct(worth, -F.col("iter"))).alias("best")
    return summary.groupBy("model").agg(best).select("best.*")


def best_iteration(
    curve: DataFrame,
    metric: str = "q_kappa",
    maximize: bool = True,
    offset: int = 1,
    digits: int | None = None,
) -> DataFrame:
    """All metrics at each model's best iteration of one metric.

    `best_iter` is the iteration number plus `offset`: for trees the number of
    trees to keep.
    """
    summary = curve_mean_std(curve)
    best = argmax_iteration(summary.where(F.col("metric") == metric), maximize, digits)
    return summary.join(best.select("model", "iter"), ["model", "iter"]).select(
        "model",
        (F.col("iter") + F.lit(offset)).alias("best_iter"),
        "metric",
        "mean",
        "std",
    )


def melt_curve(wide: DataFrame, metric: str, n_fold: int, iter_col: str = "iter") -> DataFrame:
    """One column per fold to one row per fold and iteration."""
    folds = [f"fold_{k}" for k in range(n_fold)]
    long = wide.unpivot([iter_col], folds, "fold", "value")
    return long.select(
        F.regexp_extract("fold", r"(\d+)$", 1).cast("int").alias("fold"),
        F.col(iter_col).alias("iter"),
        F.lit(metric).alias("metric"),
        "value",
    )


def shrink_to_best(models: Sequence[FoldModel], best_iter: int) -> list[FoldModel]:
    """All folds cut to the best mean iteration."""
    return [m.cut(best_iter) for m in models]


# Task-side helpers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
