"""Gold table to fold models, thresholds, rounds and importance tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.config import BASE_THRESHOLDS, ColumnRoles
from ordina.operators import explain, models, pseudo, quality
from ordina.operators.models import PRED, FoldModel
from ordina.operators.thresholds import (
    ThresholdGrid,
    grid_cross,
    threshold_gain,
    threshold_search,
)
from ordina.session import fresh_path, written
from ordina.sources.tables import scan_gold, sink_pseudo, sink_results


@dataclass
class Member:
    """One model of the blend: a name, an estimator, its thresholds and how it takes codes."""

    name: str
    estimator: Callable
    thresholds: tuple[float, ...] = BASE_THRESHOLDS
    grid: ThresholdGrid = field(default_factory=grid_cross)
    text_categories: bool = False


def feature_roles(df: DataFrame, roles: ColumnRoles) -> tuple[list[str], list[str]]:
    """Numeric features and nominal codes of a gold table."""
    names = roles.feature_columns(df)
    quality.check_numeric(df, names)
    codes = [c for c in roles.categorical if c in set(names)]
    return [c for c in names if c not in set(codes)], codes


def fit_round(
    member: Member,
    gold: DataFrame,
    roles: ColumnRoles,
    name: str = "main",
    features: tuple[Sequence[str], Sequence[str]] | None = None,
    online: bool = False,
) -> tuple[pseudo.Round, dict[str, DataFrame]]:
    """Check, fit all folds, cut to the best iteration and search thresholds."""
    numeric, codes = features or feature_roles(gold, roles)
    quality.check_finite(gold, [*numeric, *codes])
    if not online:
        quality.check_no_leaks(gold, roles.id_col, roles.n_fold)
    fitted = models.cv_fit(
        gold,
        numeric,
        codes,
        roles.target,
        member.estimator,
        roles.n_fold,
        as_text=member.text_categories,
    )
    tables = {}
    best_iter = None
    base_score = None
    if fitted[0].is_ensemble:
        curve = models.staged_metric(fitted, gold, roles.target, member.thresholds, name)
        curve = gold.sparkSession.createDataFrame(curve.collect(), curve.schema)
        summary = models.best_iteration(curve)
        found = summary.where(F.col("metric") == "q_kappa").first()
        best_iter, base_score = found["best_iter"], found["mean"]
        fitted = models.shrink_to_best(fitted, best_iter)
        tables |= {"curve": curve, "best_iteration": summary}
    scored = models.oof_predict(fitted, gold, keep=[roles.id_col, roles.target])
    # Read by the search and by whoever stores the result.
    scored = written(scored.withColumn(roles.target, F.col(roles.target).cast("int")), "oof")
    best = threshold_search(scored, "fold", roles.target, PRED, member.grid)
    if base_score is not None:
        best = threshold_gain(best, base_score)
    found = best.first().asDict()
    tables |= {"oof": scored, "thresholds": gold.sparkSession.createDataFrame([found])}
    return pseudo.Round(name, fitted, found, best_iter), tables


def train_member(
    member: Member,
    gold: DataFrame,
    unlabelled: DataFrame,
    roles: ColumnRoles,
    n_pseudo: int = 0,
    test: DataFrame | None = None,
    features: tuple[Sequence[str], Sequence[str]] | None = None,
    results_root: str | None = None,
) -> tuple[pseudo.Round, DataFrame]:
    """All rounds of one member; returns the best round and the score table."""
    spark = gold.sparkSession

    def train_round(name: str, data: DataFrame) -> pseudo.Round:
        done, tables = fit_round(
            member, data, roles, name, features, online=test is not None
        )
        if results_root:
            sink_results(tables, f"{results_root}/{member.name}/{name}")
        return done

    def store(name: str, data: DataFrame) -> DataFrame:
        path = fresh_path(spark, f"pseudo-{member.name}-{name}")
        sink_pseudo(data, path)
        return scan_gold(spark, path)

    rounds, scores = pseudo.pseudo_rounds(
        train_round, gold, unlabelled, roles.target, n_pseudo, store, test, id_col=roles.id_col
    )
    best = pseudo.argmax_round(scores).first()["round"]
    return rounds[best], scores


def explain_member(
    fitted: Sequence[FoldModel],
    gold: DataFrame,
    roles: ColumnRoles,
    repeats: int = 3,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Importance tables of a fitted member."""
    spark = gold.sparkSession
    names = fitted[0].space.features
    contribs = explain.contributions(fitted, gold, roles.id_col)
    return {
        "gain_importance": explain.rank_features(
            explain.gain_importance(spark, fitted), "importance"
        ),
        "mean_abs_contrib": explain.rank_features(
            explain.mean_abs_contrib(contribs, names), "importance"
        ),
        "permutation_importance": explain.rank_features(
            explain.permutation_importance(
                fitted, gold, roles.id_col, roles.target, names, repeats, seed
            ),
            "importance",
        ),
    }
