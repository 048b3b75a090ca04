"""Fitted members on disk: models, feature spaces, cuts, thresholds and scores."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession

from ordina.operators.models import FeatureSpace, FoldModel
from ordina.operators.pseudo import Round
from ordina.sources.versions import table_path

RESULT_TABLES = ("curve", "best_iteration", "oof", "thresholds")


def save_member(done: Round, path: str) -> None:
    """Write a fitted round below `path`: a folder per fold model and one JSON row."""
    spark = SparkSession.active()
    folds = []
    for m in done.models:
        m.model.write().overwrite().save(f"{path}/fold-{m.fold}")
        space = m.space
        folds.append(
            {
                "fold": m.fold,
                "upto": m.upto,
                "fills": space.fills,
                "flagged": space.flagged,
                "top_codes": space.top_codes,
                "labels": space.labels,
                "hashed": space.hashed,
            }
        )
    text = json.dumps({"name": done.name, "best": done.best, "best_iter": done.best_iter, "folds": folds})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/member")


def load_member(spark: SparkSession, path: str) -> Round:
    """The round that `save_member` wrote; it scores like the one that was saved."""
    found = json.loads(spark.read.text(f"{path}/member", wholetext=True).first()[0])
    models = []
    for f in found["folds"]:
        space = FeatureSpace(
            {c: float(v) for c, v in f["fills"].items()},
            tuple(f["flagged"]),
            f["top_codes"],
            {c: tuple(v) for c, v in f["labels"].items()},
            f.get("hashed", {}),
        )
        model = DefaultParamsReader.loadParamsInstance(f"{path}/fold-{f['fold']}", spark)
        models.append(FoldModel(f["fold"], space, model, f["upto"]))
    return Round(found["name"], models, found["best"], found["best_iter"])


def read_results(
    spark: SparkSession, root: str, names: Sequence[str] = RESULT_TABLES
) -> dict[str, DataFrame]:
    """The result tables that `sink_results` wrote below `root`."""
    return {name: spark.read.parquet(table_path(spark, root, name)) for name in names}
