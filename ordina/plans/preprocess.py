"""Raw subject and series tables to gold, unlabelled and test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.config import PLANAR_NORM, ColumnRoles
from ordina.functions.classes import bin_age, strata_key
from ordina.operators.encode import encode_categories
from ordina.operators.folds import fold_info, stratified_folds
from ordina.operators.series import (
    filter_near_anchor,
    join_series,
    series_summary,
    with_planar_norm,
)
from ordina.plans.row_features import AGE, row_features
from ordina.session import written
from ordina.sources.tables import publish_pair, sink_test


def summarise_series(series: DataFrame, roles: ColumnRoles, **options) -> DataFrame:
    near = with_planar_norm(filter_near_anchor(series))
    return series_summary(near, roles.id_col, (*roles.signals, PLANAR_NORM), **options)


def build_features(
    subjects: DataFrame,
    series: DataFrame,
    roles: ColumnRoles,
    with_target: bool = True,
    zero: str = "null",
    **options,
) -> DataFrame:
    """Encoded subjects with row features and the series summary, one lazy plan."""
    return with_summary(subjects, summarise_series(series, roles, **options), roles, with_target, zero)


def with_summary(
    subjects: DataFrame, summary: DataFrame, roles: ColumnRoles, with_target: bool = True, zero: str = "null"
) -> DataFrame:
    """The features of `build_features` with a summary that is there already."""
    encoded = encode_categories(subjects, roles, with_target)
    wide = row_features(encoded, roles, zero)
    return join_series(wide, summary, roles.id_col)


def assign_folds(df: DataFrame, roles: ColumnRoles, seed: int = 0) -> DataFrame:
    """`fold_info` for labelled rows, stratified by age bucket and target."""
    key = strata_key(bin_age(AGE), F.col(roles.target))
    folds = stratified_folds(df, roles.id_col, key, roles.n_fold, seed)
    return fold_info(folds, "fold", roles.n_fold).drop("fold")


def prepare_training(
    subjects: DataFrame,
    series: DataFrame,
    roles: ColumnRoles,
    gold_path: str,
    unlabelled_path: str,
    seed: int = 0,
    zero: str = "null",
    summary: DataFrame | None = None,
) -> None:
    """Write the gold and the unlabelled table, in one commit.

    The features are written once before the folds are drawn, since drawing
    them reads the table twice. A `summary` of the series that is there already, as
    `summarise_series` gives it, is not made again.
    """
    summary = summarise_series(series, roles) if summary is None else summary
    features = written(with_summary(subjects, summary, roles, True, zero), "features")
    labelled = assign_folds(features.where(F.col(roles.target).isNotNull()), roles, seed)
    unlabelled = features.where(F.col(roles.target).isNull())
    publish_pair(labelled, unlabelled, gold_path, unlabelled_path)


def prepare_test(
    subjects: DataFrame,
    series: DataFrame,
    roles: ColumnRoles,
    test_path: str,
    zero: str = "null",
    summary: DataFrame | None = None,
) -> None:
    """Write the test table; `summary` as for `prepare_training`."""
    summary = summarise_series(series, roles) if summary is None else summary
    sink_test(with_summary(subjects, summary, roles, False, zero), test_path)
