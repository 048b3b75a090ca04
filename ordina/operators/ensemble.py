"""Blends of several models."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.config import BASE_THRESHOLDS, ENSEMBLE_THRESHOLD_POINTS
from ordina.operators.models import PRED, threshold_predict
from ordina.operators.thresholds import ThresholdGrid, grid_cross, threshold_search


def union_lists(lists: Iterable[Sequence[str]]) -> list[str]:
    """Distinct names of several feature lists, in order of first sight."""
    return list(dict.fromkeys(name for names in lists for name in names))


def ensemble_grid(base: Sequence[float] = BASE_THRESHOLDS) -> ThresholdGrid:
    return grid_cross(base, points=ENSEMBLE_THRESHOLD_POINTS)


def ensemble_scores(preds: DataFrame, n_models: int, by: Sequence[str]) -> DataFrame:
    """Sum over the models of `pred / n_models`; null if a model is missing."""
    complete = F.count(PRED) == F.lit(n_models)
    mean = F.sum(F.col(PRED) / F.lit(float(n_models)))
    return preds.groupBy(*by).agg(F.when(complete, mean).alias(PRED))


def ensemble_oof(
    preds: DataFrame,
    target: str,
    n_models: int,
    id_col: str = "id",
    grid: ThresholdGrid | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Best threshold tuple of the blended validation scores.

    `preds` has one row per id, fold and model, with the target.
    """
    blended = ensemble_scores(preds, n_models, [id_col, "fold", target])
    return threshold_search(blended, "fold", target, PRED, grid or ensemble_grid(), digits)


def ensemble_predict(
    preds: DataFrame,
    n_models: int,
    n_fold: int,
    thresholds: Sequence[float],
    id_col: str = "id",
) -> DataFrame:
    """Score and class per id from `(id, fold, model, pred)` rows, one shuffle."""
    complete = F.count(PRED) == F.lit(n_models * n_fold)
    mean = F.sum(F.col(PRED) / F.lit(float(n_fold)) / F.lit(float(n_models)))
    blended = preds.groupBy(id_col).agg(F.when(complete, mean).alias(PRED))
    return threshold_predict(blended, thresholds)
