"""Checks on a table before it is fitted on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns_of_type(df: DataFrame, *types: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types)]


def check_numeric(df: DataFrame, columns: Sequence[str], allow_text: bool = False) -> None:
    """Fail unless every column is numeric (or text, when that is allowed)."""
    allowed = (T.NumericType, T.StringType) if allow_text else (T.NumericType,)
    wrong = sorted(set(columns) - set(columns_of_type(df, *allowed)))
    if wrong:
        raise TypeError(f"columns that cannot be fitted on: {', '.join(wrong)}")


def inf_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: infinite values over all given columns, text columns left out."""
    numeric = [c for c in columns if c in set(columns_of_type(df, T.FractionalType))]
    if not numeric:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("any_infinite"))
    counts = [F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))) for c in numeric]
    return df.agg(reduce(add, counts).alias("any_infinite"))


def check_finite(df: DataFrame, columns: Sequence[str]) -> None:
    found = inf_count(df, columns).first()[0]
    if found:
        raise ValueError(f"{found} infinite feature values")


def distinct_ids(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(id_col).distinct()


def intersect_ids(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Ids present on both sides, each once; both sides are reduced before they meet."""
    return distinct_ids(left, id_col).join(distinct_ids(right, id_col), id_col, "left_semi")


leak_check = intersect_ids


def check_no_leak(train: DataFrame, valid: DataFrame, id_col: str) -> None:
    shared = leak_check(train, valid, id_col).count()
    if shared:
        raise ValueError(f"{shared} ids are in both the train and the validation rows")


def leaks_by_fold(df: DataFrame, id_col: str, n_fold: int, info_col: str = "fold_info") -> DataFrame:
    """Ids that train and validate the same fold, counted for all folds in one pass."""
    flags = F.split(info_col, ", ")
    per_id = df.groupBy(id_col).agg(
        *[
            (
                F.max((F.get(flags, F.lit(k)) == "t").cast("int"))
                * F.max((F.get(flags, F.lit(k)) == "v").cast("int"))
            ).alias(f"fold_{k}")
            for k in range(n_fold)
        ]
    )
    return per_id.agg(
        *[F.coalesce(F.sum(f"fold_{k}"), F.lit(0)).alias(f"fold_{k}") for k in range(n_fold)]
    )


def check_no_leaks(df: DataFrame, id_col: str, n_fold: int) -> None:
    found = leaks_by_fold(df, id_col, n_fold).first()
    if any(found):
        raise ValueError(f"ids in both the train and the validation rows, per fold: {tuple(found)}")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))
