"""Stratified folds and the views on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordina.functions.classes import fold_entry
from ordina.operators.ranking import HASH_DIGITS, hash_key, running_total


def split_labelled(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(target).isNotNull()), df.where(F.col(target).isNull())


def stratified_folds(
    df: DataFrame, id_col: str, strata: Column, k: int, seed: int = 0, out: str = "fold"
) -> DataFrame:
    """Fold 0..k-1 per row, dealt in turn along the strata in a seeded random order.

    Rows are numbered through all strata, so fold sizes differ by at most one
    inside each stratum and overall. The numbering runs inside hash buckets of a
    stratum, and what lies before a bucket comes from the bucket totals. A row without
    id gets a fold like any other.
    """
    keyed = (
        df.withColumn("__stratum", F.coalesce(strata.cast("string"), F.lit("null")))
        .withColumn("__key", hash_key(seed, id_col))
        .withColumn("__bucket", F.substring("__key", 1, HASH_DIGITS))
    )
    numbered = running_total(
        keyed, [], ["__stratum", "__bucket"], ["__key", id_col], F.lit(1), "__number"
    )
    return numbered.withColumn(out, ((F.col("__number") - 1) % k).cast("int")).drop(
        "__stratum", "__key", "__bucket", "__number"
    )


def fold_info(df: DataFrame, fold_col: str, k: int, out: str = "fold_info") -> DataFrame:
    """The `t`/`v` flags of all folds as one string, `n` everywhere without a fold."""
    fold = F.col(fold_col)
    flags = [
        F.when(fold != i, F.lit("t")).when(fold == i, F.lit("v")).otherwise(F.lit("n"))
        for i in range(k)
    ]
    return df.withColumn(out, F.concat_ws(", ", *flags))


def fold_view(df: DataFrame, k: int, info_col: str = "fold_info") -> tuple[DataFrame, DataFrame]:
    """Train and validation rows of fold `k`."""
    current = df.withColumn("current_fold", fold_entry(info_col, k))
    return current.where(F.col("current_fold") == "t"), current.where(F.col("current_fold") == "v")


def fold_report(df: DataFrame, by: str, info_col: str = "fold_info") -> DataFrame:
    return df.groupBy(by, info_col).agg(F.count(F.lit(1)).alias("n")).orderBy(by, info_col)


def first_validation_info(df: DataFrame, k: int, info_col: str = "fold_info") -> DataFrame:
    """The `fold_info` text of the rows that validate fold `k` (one row)."""
    valid = fold_view(df, k, info_col)[1]
    return valid.agg(F.min(info_col).alias(info_col))


def sort_report(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.orderBy(*by)
