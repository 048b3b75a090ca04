"""Pseudo-labelled training sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.functions.classes import pseudo_fold_info
from ordina.operators.models import score_all, union_all


def common_columns(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """Columns of `left` that `right` has too, in the order of `left`."""
    known = set(right)
    return [c for c in left if c in known]


def union_strict(base: DataFrame, *parts: DataFrame) -> DataFrame:
    """Rows of all frames in the schema of the first one; casts that fail, fail the query."""
    shaped = [
        p.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in base.schema.fields])
        for p in parts
    ]
    return union_all([base, *shaped])


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, each column widened to the common type."""
    return union_all(frames)


def pseudo_rows(models: Sequence, df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Every row once per fold: the fold's raw score as target, training that fold only.

    All folds score in one pass; the rows are then repeated.
    """
    own = [c for c in columns if c not in (target, "fold_info")]
    wide, names = score_all(models, df, own)
    made = F.array(
        *[
            F.struct(
                F.col(name).cast("double").alias("__target"),
                F.lit(pseudo_fold_info(m.fold, len(models))).alias("__info"),
            )
            for m, name in zip(models, names)
        ]
    )
    long = wide.select(*[f"`{c}`" for c in own], F.inline(made))
    named = {target: F.col("__target").alias(target), "fold_info": F.col("__info").alias("fold_info")}
    return long.select(*[named.get(c, F.col(f"`{c}`")) for c in columns])


def _shared(
    labelled: DataFrame, unlabelled: DataFrame, target: str, test: DataFrame | None
) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """The labelled rows with a number as target, the frames that get scores, and the columns of the result."""
    base = labelled.withColumn(target, F.col(target).cast("double"))
    if test is None:
        return base, [unlabelled], base.columns
    columns = common_columns([*test.columns, target, "fold_info"], base.columns)
    columns = list(dict.fromkeys(columns))
    return base.select(*[f"`{c}`" for c in columns]), [unlabelled, test], columns


def pseudo_label(
    models: Sequence,
    labelled: DataFrame,
    unlabelled: DataFrame,
    target: str,
    test: DataFrame | None = None,
) -> DataFrame:
    """Labelled rows plus the unlabelled ones once per fold with that fold's score.

    With `test` its rows are added the same way, and all parts are cut to the
    columns the test table has.
    """
    base, parts, columns = _shared(labelled, unlabelled, target, test)
    return union_strict(base, *[pseudo_rows(models, p, target, columns) for p in parts])


def pseudo_scores(
    models: Sequence, unlabelled: DataFrame, id_col: str, test: DataFrame | None = None
) -> DataFrame:
    """(part, id, score, fold_info): what a pseudo-labelled set adds to rows that are stored already.

    Part 0 are the unlabelled rows, part 1 those of `test`. A row and fold take a few
    bytes, whatever the width of the tables.
    """
    out = []
    for i, df in enumerate([unlabelled] if test is None else [unlabelled, test]):
        wide, names = score_all(models, df, [id_col])
        made = [
            F.struct(F.col(name).cast("double").alias("score"), F.lit(pseudo_fold_info(m.fold, len(models))).alias("fold_info"))
            for m, name in zip(models, names)
        ]
        out.append(wide.select(F.lit(i).alias("part"), F.col(f"`{id_col}`").alias("id"), F.inline(F.array(*made))))
    return union_all(out)


def pseudo_set(
    labelled: DataFrame,
    unlabelled: DataFrame,
    scores: DataFrame,
    id_col: str,
    target: str,
    test: DataFrame | None = None,
) -> DataFrame:
    """The rows of `pseudo_label`, from the stored tables and the `pseudo_scores` of them.

    The unlabelled rows are joined with their scores when they are read; a filter on the
    fold reaches the folders of the scores. Ids must not repeat inside a table; rows
    without id have no score and are left out.
    """
    base, parts, columns = _shared(labelled, unlabelled, target, test)
    made = []
    for i, part in enumerate(parts):
        own = [c for c in columns if c not in (target, "fold_info")]
        rows = part.select(*[f"`{c}`" for c in own], F.col(f"`{id_col}`").alias("__id"))
        found = scores.where(F.col("part") == i).select(F.col("id").alias("__of"), F.col("score").alias(target), "fold_info")
        joined = rows.join(found, F.col("__id") == F.col("__of"))
        made.append(joined.select(*[f"`{c}`" for c in columns]))
    return union_strict(base, *made)


@dataclass(frozen=True)
class Round:
    """One fitting round: its name, models and best threshold tuple."""

    name: str
    models: list
    best: dict
    best_iter: int | None = None


def round_names(base: str, n: int) -> list[str]:
    return [base] + [f"{base}_pseudo_{i}" for i in range(n)]


def pseudo_rounds(
    train_round: Callable[[str, DataFrame], Round],
    labelled: DataFrame,
    unlabelled: DataFrame,
    target: str,
    n_rounds: int,
    store: Callable[[str, DataFrame], DataFrame],
    test: DataFrame | None = None,
    base_name: str = "main",
    id_col: str | None = None,
) -> tuple[list[Round], DataFrame]:
    """Fit, relabel, fit again; returns all rounds and their score table.

    Each round relabels the original rows with the models of the round before.
    `store` writes a round's training set and returns it read back, so plans do
    not grow from round to round. With `id_col` it only gets the scores of a round,
    which are joined to the original rows whenever the training set is read.
    """
    names = round_names(base_name, n_rounds)
    rounds = [train_round(names[0], labelled)]
    for name in names[1:]:
        if id_col is None:
            data = store(name, pseudo_label(rounds[-1].models, labelled, unlabelled, target, test))
        else:
            scores = store(name, pseudo_scores(rounds[-1].models, unlabelled, id_col, test))
            data = pseudo_set(labelled, unlabelled, scores, id_col, target, test)
        rounds.append(train_round(name, data))
    scores = labelled.sparkSession.createDataFrame(
        [(i, r.name, r.best["score"]) for i, r in enumerate(rounds)],
        "round int, name string, score double",
    )
    return rounds, scores


def argmax_round(scores: DataFrame, digits: int | None = None) -> DataFrame:
    """The round with the best score; the first one among equals."""
    score = F.col("score") if digits is None else F.round("score", digits)
    return scores.orderBy(score.desc_nulls_last(), "round").limit(1)
