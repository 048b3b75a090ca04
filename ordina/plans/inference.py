"""Test features to a submission table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.config import ColumnRoles
from ordina.operators import ensemble, models
from ordina.operators.models import PRED
from ordina.sources.tables import sink_submission


def blend_members(members: Mapping[str, Sequence], df: DataFrame, out: str = PRED) -> DataFrame:
    """Mean over the members of their fold blends, row by row."""
    names = [f"__member_{i}" for i in range(len(members))]
    for name, fitted in zip(names, members.values()):
        df = models.blend_score(fitted, df, name)
    parts = [F.col(n) / F.lit(float(len(names))) for n in names]
    return df.withColumn(out, reduce(lambda a, b: a + b, parts)).drop(*names)


def search_blend(
    members: Mapping[str, Sequence],
    gold: DataFrame,
    roles: ColumnRoles,
    grid=None,
    digits: int | None = None,
) -> DataFrame:
    """Best threshold tuple of the blended validation scores."""
    keep = [roles.id_col, roles.target]
    keyed = [
        models.oof_predict(fitted, gold, keep=keep).withColumn(
            roles.target, F.col(roles.target).cast("int")
        )
        for fitted in members.values()
    ]
    return ensemble.ensemble_oof(
        models.union_all(keyed), roles.target, len(members), roles.id_col, grid, digits
    )


def submit(
    members: Mapping[str, Sequence],
    test: DataFrame,
    roles: ColumnRoles,
    path: str,
    thresholds: Sequence[float] | None,
) -> DataFrame:
    """Write `(id, target)`: classes, or raw scores when no thresholds are given."""
    scored = blend_members(members, test)
    if thresholds is None:
        sink_submission(scored, path, roles.id_col, PRED, roles.target)
    else:
        classed = models.threshold_predict(scored, thresholds)
        sink_submission(classed, path, roles.id_col, "class", roles.target)
    return test.sparkSession.read.parquet(path)
