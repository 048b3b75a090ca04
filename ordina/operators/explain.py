"""Importance tables: split gain, permutation and additive contributions."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordina.config import BASE_THRESHOLDS
from ordina.functions.classes import fold_entry, round_half_even, round_to_class, validation_fold
from ordina.operators import trees
from ordina.operators.metrics import cell_counts, kappa_of_cells, qwk_classes
from ordina.operators.models import PRED, FoldModel, union_all
from ordina.operators.ranking import shuffled_rank
from ordina.operators.series import series_subset
from ordina.session import written


def rank_features(table: DataFrame, value: str, k: int | None = None) -> DataFrame:
    """Features by falling value, ties by name; the first `k` for a report."""
    ordered = table.orderBy(F.col(value).desc_nulls_last(), "feature")
    return ordered if k is None else ordered.limit(k)


def importance_mean(table: DataFrame, value: str = "importance") -> DataFrame:
    return table.groupBy("feature").agg(F.avg(value).alias(value))


# --- split gain --------------------------------------------------------------


def gain_by_fold(spark, models: Sequence[FoldModel], kind: str = "total") -> DataFrame:
    """`(fold, feature, importance)`: split gain, 0 for a feature never used.

    `total` adds up the gains, weighted by rows, of the trees up to the cut. `mean` is
    the mean of these gains per split over all trees. The table has one row per fold
    and feature, whatever the data size.
    """
    if kind not in ("total", "mean"):
        raise ValueError(f"unknown kind of gain {kind}")
    rows = []
    for m in models:
        gains = dict.fromkeys(m.space.features, 0.0)
        splits = dict.fromkeys(m.space.features, 0)
        owners = m.space.slot_owners
        for tree in m.trees[: (m.upto or m.n_trees) if kind == "total" else m.n_trees]:
            for f, g, cover in zip(tree.feature, tree.gain, tree.cover):
                if f >= 0:
                    gains[owners[f]] += float(g * cover)
                    splits[owners[f]] += 1
        if kind == "mean":
            gains = {f: g / max(1, splits[f]) for f, g in gains.items()}
        rows += [(m.fold, f, g) for f, g in gains.items()]
    return spark.createDataFrame(rows, "fold int, feature string, importance double")


def gain_importance(spark, models: Sequence[FoldModel], kind: str = "total") -> DataFrame:
    return importance_mean(gain_by_fold(spark, models, kind))


# --- permutation -------------------------------------------------------------


def permuted_pairs(
    df: DataFrame,
    id_col: str,
    features: Sequence[str],
    repeats: int,
    seed: int,
    fold_col: str = "fold",
) -> DataFrame:
    """Each row with the features of a random partner of its fold, once per repeat.

    Two seeded orders of the fold are matched by rank; the first one serves all
    repeats. The partners of a repeat are the same for all features, so the
    shuffles do not multiply with them.
    """
    own = shuffled_rank(df, [fold_col], id_col, f"{seed}-a-", "__rank")
    partner = F.struct(*[F.col(f"`{c}`") for c in features]).alias("__partner")
    others = [
        shuffled_rank(
            df.select(fold_col, id_col, *[f"`{c}`" for c in features]),
            [fold_col],
            id_col,
            f"{seed}-b{r}-",
            "__rank",
        ).select(fold_col, "__rank", partner, F.lit(r).alias("repeat"))
        for r in range(repeats)
    ]
    return own.join(union_all(others), [fold_col, "__rank"]).drop("__rank")


def permutation_scores(
    models: Sequence,
    df: DataFrame,
    id_col: str,
    target: str,
    features: Sequence[str],
    repeats: int = 3,
    seed: int = 0,
    thresholds: Sequence[float] = BASE_THRESHOLDS,
    info_col: str = "fold_info",
) -> DataFrame:
    """`(feature, repeat, fold, qwk, base)`: kappa with the one feature shuffled inside the fold, and without.

    Each repeat shuffles the rows anew.
    """
    if all(getattr(m, "is_ensemble", False) for m in models):
        return _tree_shuffles(models, df, id_col, target, features, repeats, seed, thresholds, info_col)
    return _whole_shuffles(models, df, id_col, target, features, repeats, seed, thresholds, info_col)


def _whole_shuffles(models, df, id_col, target, features, repeats, seed, thresholds, info_col) -> DataFrame:
    """For models that can only be asked for a whole score: a row for each feature and repeat."""
    n_classes = len(thresholds) + 1
    y, p = round_half_even(target), round_to_class(PRED, thresholds)
    valid = df.withColumn("fold", validation_fold(info_col)).where(F.col("fold").isNotNull())
    pairs = permuted_pairs(valid, id_col, features, repeats, seed)
    # Each model reads the pairs of its fold; the shuffles above run once.
    pairs = written(pairs, "permuted", ["fold"])
    each = pairs.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    mixed = each.withColumns(
        {
            c: F.when(F.col("__at") == i, F.col("__partner").getField(c)).otherwise(F.col(f"`{c}`"))
            for i, c in enumerate(features)
        }
    )
    kept = ["__at", "repeat", "fold", target]
    scored = union_all(
        [m.score(mixed.where(F.col("fold") == m.fold), PRED, kept) for m in models]
    ).withColumn("feature", F.get(F.lit(list(features)), F.col("__at")))
    shuffled = qwk_classes(scored, y, p, ["feature", "repeat", "fold"], n_classes)
    plain = union_all([m.score(valid.where(F.col("fold") == m.fold), PRED, [target, "fold"]) for m in models])
    base = qwk_classes(plain, y, p, ["fold"], n_classes).withColumnRenamed("qwk", "base")
    return shuffled.join(base, "fold").select("feature", "repeat", "fold", "qwk", "base")


def _tree_shuffles(models, df, id_col, target, features, repeats, seed, thresholds, info_col) -> DataFrame:
    """For trees: only those that split on the feature are walked again.

    A row keeps the leaf values of all its trees and their sum. A shuffle of a feature
    walks the trees that an index lists for it, with that feature's values from the row's
    partner, and adds the differences to the sum. The row only tells the features that
    change its class; the confusion matrix of a shuffle is the plain one and these moves.
    """
    n_classes = len(thresholds) + 1
    wanted = list(features)
    rows = []
    for group in trees.node_groups(models):
        forests = trees.by_fold(group, trees.forest_entry, trees.FOREST)
        slots = trees.validation_slots(group, df, [id_col, target], info_col)
        values = trees.bound(
            {"f": F.get(forests, F.col("fold")), "x": F.col("__x")}, lambda b: trees.leaf_values(b["f"], b["x"])
        )
        y = round_half_even(target)
        odd = F.raise_error(F.lit("a class lies outside the known range")).cast("int")
        label = F.when(y.between(0, n_classes - 1), y).otherwise(odd)
        rows.append(slots.select(F.col(f"`{id_col}`").alias("__id"), "fold", label.alias("y"), "__x", values.alias("__values")))
    # A row per validation row: its tested slots and leaf values.
    rows = written(union_all(rows), "leaves", ["fold"])
    pairs = written(permuted_pairs(rows, "__id", ["__x"], repeats, seed), "permuted", ["fold"])

    def score(f: Column, total: Column) -> Column:
        return round_to_class(total / F.element_at(f["divisors"], -1), thresholds)

    moved, plain = [], []
    for group in trees.node_groups(models):
        forests = F.get(trees.by_fold(group, trees.forest_entry, trees.FOREST), F.col("fold"))
        places = F.from_json(F.lit(json.dumps(_places(group, wanted))), "array<array<int>>")
        folds = F.col("fold").isin([m.fold for m in group])

        def changes(b: Column) -> Column:
            f = b["f"]
            total = trees.summed(b["values"])

            def one(use: Column, was: Column, sums: Column) -> Column:
                def value_at(node: Column) -> Column:
                    return F.when(node["o"] == use["o"], F.get(b["z"], node["s"])).otherwise(F.get(b["x"], node["s"]))

                def again(acc: Column, t: Column) -> Column:
                    value = trees.leaf_value(f, F.get(f["roots"], t), value_at)
                    return acc + (value - F.get(b["values"], t))

                change = F.aggregate(use["trees"], F.lit(0.0), again)
                return F.struct(
                    F.get(b["places"], use["o"]).alias("feature"), was.alias("before"), score(f, sums + change).alias("after")
                )

            def told(c: Column) -> Column:
                each = F.transform(f["uses"], lambda use: one(use, c["was"], c["total"]))
                return F.filter(each, lambda e: (e["before"] != e["after"]) & (e["feature"] >= 0))

            return trees.bound({"was": score(f, total), "total": total}, told)

        read = pairs.where(folds)
        told = trees.bound(
            {
                "f": forests, "places": F.get(places, F.col("fold")), "x": F.col("__x"),
                "z": F.col("__partner").getField("__x"), "values": F.col("__values"),
            },
            changes,
        )
        moved.append(read.select("fold", "repeat", "y", F.inline(told)))
        own = trees.bound({"f": forests, "values": F.col("__values")}, lambda b: score(b["f"], trees.summed(b["values"])))
        plain.append(rows.where(folds).select("fold", "y", own.alias("p")))

    moved = union_all(moved).groupBy("fold", "repeat", "feature", "y", "before", "after").agg(F.count(F.lit(1)).alias("n"))
    moves = F.array(
        F.struct(F.col("after").alias("p"), F.col("n").alias("d")),
        F.struct(F.col("before").alias("p"), (-F.col("n")).alias("d")),
    )
    moved = moved.select("fold", "repeat", "feature", "y", F.inline(moves))
    # At most a row for each fold and cell of the matrix; then one for each feature and repeat.
    plain = written(union_all(plain).groupBy("fold", "y", "p").agg(F.count(F.lit(1)).alias("d")), "plain")
    each = plain.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "feature", F.explode(F.sequence(F.lit(0), F.lit(len(wanted) - 1)))
    )
    cells = each.unionByName(moved).groupBy("fold", "repeat", "feature")
    cells = cells.agg(*cell_counts(F.col("y"), F.col("p"), n_classes, F.col("d")))
    base = plain.groupBy("fold").agg(*cell_counts(F.col("y"), F.col("p"), n_classes, F.col("d")))
    shuffled = kappa_of_cells(cells, n_classes).join(kappa_of_cells(base, n_classes, "base"), "fold")
    named = F.get(F.lit(wanted), F.col("feature"))
    return shuffled.select(named.alias("feature"), "repeat", "fold", "qwk", "base")


def _places(models: Sequence, wanted: list[str]) -> list:
    """Per fold, for each feature of its space the place among the wanted ones, or -1."""
    at = {f: i for i, f in enumerate(wanted)}
    found = {m.fold: [at.get(f, -1) for f in m.space.features] for m in models}
    return [found.get(k) for k in range(max(found) + 1)]


def permutation_importance(
    models: Sequence,
    df: DataFrame,
    id_col: str,
    target: str,
    features: Sequence[str],
    repeats: int = 3,
    seed: int = 0,
    thresholds: Sequence[float] = BASE_THRESHOLDS,
    info_col: str = "fold_info",
) -> DataFrame:
    """`(feature, importance)`: mean fold kappa minus its mean over the shuffles.

    A feature that no model splits on leaves every score as it is: its importance is 0
    and its shuffles are not scored. Every repeat is a shuffle of the rows as they were,
    not of the repeat before.
    """
    used = _split_on(models, features)
    unused = [f for f in features if f not in used]
    features = [f for f in features if f in used]
    zeros = df.sparkSession.createDataFrame([(f, 0.0) for f in unused], "feature string, importance double")
    if not features:
        return zeros
    scores = permutation_scores(models, df, id_col, target, features, repeats, seed, thresholds, info_col)
    # Every feature and repeat has all folds once.
    importance = (F.avg("base") - F.avg("qwk")).alias("importance")
    return scores.groupBy("feature").agg(importance).unionByName(zeros)


def _split_on(models: Sequence, features: Sequence[str]) -> set[str]:
    """Features that some model may read; for trees up to the cut, those of their splits."""
    found: set[str] = set()
    for m in models:
        if not getattr(m, "is_ensemble", False):
            return set(features)
        for tree in m.trees[: m.upto or m.n_trees]:
            found.update(m.space.slot_owners[f] for f in tree.feature if f >= 0)
    return found


# --- additive contributions --------------------------------------------------


def contributions(
    models: Sequence,
    df: DataFrame,
    id_col: str,
    info_col: str = "fold_info",
) -> DataFrame:
    """`(id, fold, bias, contributions)` of each validation row under its fold's model.

    The contributions are the Shapley values of the tree ensemble, one per
    feature in the order of `FeatureSpace.features`; with the bias they add up
    to the prediction. They are looked up: each leaf has tables of its Shapley values,
    keyed by the bits of the tests on its path that the row passes. Folds whose tables
    hold more than `trees.NUMBERS_AT_ONCE` numbers, that is with deep trees, are
    computed in batches instead.
    """
    sizes = {m.fold: trees.game_numbers(m) for m in models}
    small = [m for m in models if sizes[m.fold] <= trees.NUMBERS_AT_ONCE]
    parts = [_computed(m, df, id_col, info_col) for m in models if m not in small]
    for group in trees.in_groups(small, lambda m: sizes[m.fold], trees.NUMBERS_AT_ONCE):
        games = F.get(trees.by_fold(group, trees.games_entry, trees.GAMES), F.col("fold"))
        found = trees.bound(
            {"g": games, "x": F.col("__x")},
            lambda b: F.struct(b["g"]["bias"].alias("bias"), trees.shapley(b["g"], b["x"]).alias("contributions")),
        )
        rows = trees.validation_slots(group, df, [id_col], info_col)
        parts.append(rows.select(f"`{id_col}`", "fold", F.inline(F.array(found))))
    return union_all(parts)


def _computed(m, df: DataFrame, id_col: str, info_col: str) -> DataFrame:
    vectors = df.where(fold_entry(info_col, m.fold) == "v").select(f"`{id_col}`", F.expr(m.space.slots_sql).alias("x"))
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, bias double, contributions array<double>"
    found = vectors.mapInPandas(_contributor(m, id_col), schema)
    return found.select(f"`{id_col}`", F.lit(m.fold).alias("fold"), "bias", "contributions")


def _contributor(m, id_col: str):
    kept = trees.kept_trees(m)
    scale = 1.0 / sum(w for _, w in kept) if m.averages else 1.0
    paths = [(value * w * scale, used) for tree, w in kept for value, used in trees.leaf_paths(tree)]
    bias = sum(value * float(np.prod([r for _, r, _ in used])) for value, used in paths)
    names = m.space.features
    owner = [names.index(o) for o in m.space.slot_owners]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["x"].to_numpy())
            total = np.zeros((len(x), len(names)))
            for value, used in paths:
                agrees = [_passes(x[:, slot], tests).astype(float) for slot, _, tests in used]
                for (slot, _, _), own in zip(used, trees.leaf_game(value, [r for _, r, _ in used], agrees)):
                    total[:, owner[slot]] += own
            yield pd.DataFrame({id_col: batch[id_col], "bias": bias, "contributions": list(total)})

    return run


def _passes(x: np.ndarray, tests: list) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for codes, threshold, goes_left in tests:
        left = np.isin(x, list(codes)) if codes is not None else x <= threshold
        ok &= left if goes_left else ~left
    return ok


def mean_abs_contrib(contribs: DataFrame, features: Sequence[str]) -> DataFrame:
    """`(feature, importance)`: mean absolute contribution per fold, then over folds."""
    names = F.lit(list(features))
    return (
        contribs.select("fold", F.posexplode("contributions").alias("slot", "value"))
        .groupBy("fold", F.get(names, F.col("slot")).alias("feature"))
        .agg(F.avg(F.abs("value")).alias("importance"))
        .groupBy("feature")
        .agg(F.avg("importance").alias("importance"))
    )


def contributions_series(
    models: Sequence[FoldModel], df: DataFrame, id_col: str, info_col: str = "fold_info"
) -> DataFrame:
    """Contributions of the rows that have series data."""
    return contributions(models, series_subset(df), id_col, info_col)


# Task-side helpers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(trees)
