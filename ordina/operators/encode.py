"""Encoders, imputers and scalers fitted on one frame and applied to others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.config import ColumnRoles
from ordina.functions.classes import encode_label, fill_none
from ordina.operators.quantiles import refine, sketches
from ordina.operators.ranking import prefix_starts
from ordina.session import written

MAX_COLUMNS = 10_000


def encode_categories(df: DataFrame, roles: ColumnRoles, with_target: bool = True) -> DataFrame:
    """Codes and season labels as shorts; the target too when it is there to train on.

    The casts are ANSI casts: a value that does not fit fails the query.
    """
    new = {c: F.col(c).cast("short") for c in roles.codes}
    new |= {c: encode_label(c, roles.label_maps[c]) for c in roles.seasons}
    if with_target:
        new[roles.target] = F.col(roles.target).cast("short")
    return df.withColumns(new)


def fill_none_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: fill_none(c) for c in columns})


def _no_nan(df: DataFrame, column: str) -> Column:
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return F.nanvl(column, F.lit(None)) if floating else F.col(column)


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the mean of each column, from one aggregate; NaN counts as missing."""
    return df.agg(*[F.avg(_no_nan(df, c)).alias(c) for c in columns])


def column_max_plus_one(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with `max + 1` of each column: its code for a missing value."""
    return df.agg(*[(F.max(c) + F.lit(1)).alias(c) for c in columns])


def _fill(df: DataFrame, stats: DataFrame, only: Row, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {
            c: F.coalesce(_no_nan(df, c), F.lit(only[c]).cast(stats.schema[c].dataType))
            for c in columns
            if only[c] is not None
        }
    )


def impute_train_mean(
    train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]
) -> list[DataFrame]:
    """Nulls and NaN become the train mean, in the train rows and in all others."""
    means = column_means(train, columns)
    only = means.first()
    return [_fill(df, means, only, columns) for df in (train, *others)]


def impute_max_plus_one(
    train: DataFrame,
    others: Sequence[DataFrame],
    columns: Sequence[str],
    per_split: bool = True,
) -> list[DataFrame]:
    """Missing codes become `max + 1` of each split, or of the train rows for all."""
    out = []
    tops = only = None
    for df in (train, *others):
        if only is None or per_split:
            tops = column_max_plus_one(df, columns)
            only = tops.first()
        out.append(_fill(df, tops, only, columns))
    return out


def category_rows(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct `(*by, column, value)` of the non-null values, from one pass over `df`."""
    entries = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                for c in columns
            ]
        )
    )
    rows = df.select(*by, entries.alias("e")).select(*by, "e.*")
    return rows.where(F.col("value").isNotNull()).distinct()


def sorted_labels(df: DataFrame, column: str, labels: Sequence[str]) -> list[str]:
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    return sorted(labels, key=float if numeric else None)


def label_counts(rows: DataFrame) -> dict[str, int]:
    """How many labels each column of `category_rows` has: a row per column."""
    counted = rows.groupBy("column").agg(F.countDistinct("value").alias("n"))
    return {r["column"]: r["n"] for r in counted.collect()}


def categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted distinct non-null values per column; each becomes a column.

    They are counted before they are fetched. Above `MAX_COLUMNS` it is an error: a
    table cannot have that many columns, `one_hot_slots` gives places instead.
    """
    found: dict[str, list] = {c: [] for c in columns}
    if not columns:
        return found
    rows = written(category_rows(df, columns), "labels")
    total = rows.count()
    if total > MAX_COLUMNS:
        raise ValueError(f"{total} labels would be as many columns; one_hot_slots takes any number")
    for row in rows.collect():
        found[row["column"]].append(row["value"])
    return {c: sorted_labels(df, c, values) for c, values in found.items()}


def one_hot_columns(column: str, values: Sequence[str]) -> dict[str, Column]:
    """Indicator columns; two categories share one column with +1, -1 and 0."""
    text = F.col(column).cast("string")

    def hit(v):
        return F.coalesce((text == F.lit(v)).cast("double"), F.lit(0.0))

    if len(values) == 2:
        return {column: hit(values[0]) - hit(values[1])}
    return {f"{column}={v}": hit(v) for v in values}


def one_hot_missing_zero(
    train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]
) -> list[DataFrame]:
    """One-hot with the train categories; unseen and missing values are all zeros."""
    found = categories(train, columns)

    def encode(df):
        added = {}
        for c in columns:
            added |= one_hot_columns(c, found[c])
        kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
        return df.select(*kept, *[expr.alias(name) for name, expr in added.items()])

    return [encode(df) for df in (train, *others)]


def label_dictionary(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, slot): every label of `train` with its place, columns one after another.

    Inside a column labels stand in the order of `sorted_labels`. The table is written
    once; places come from ranges of labels, so no task and no driver holds them all.
    """
    rows = category_rows(train, columns)
    order = F.array_position(F.lit(list(columns)), F.col("column")).cast("int").alias("__at")
    numeric = [c for c in columns if isinstance(train.schema[c].dataType, T.NumericType)]
    number = F.when(F.col("column").isin(numeric), F.col("value").try_cast("double")).alias("__number")
    ranked = prefix_starts(rows.select("column", "value", order, number), ["__at", "__number", "value"], F.lit(1))
    return written(ranked.select("column", "value", F.col("__start").alias("slot")), "dictionary")


def one_hot_slots(
    train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]
) -> list[DataFrame]:
    """One-hot codes as places: each column becomes `<column>_slot`, where its 1 stands.

    For columns with any number of labels. Frames are joined with the dictionary of the
    train labels, which Spark broadcasts only if its files are below the session's
    threshold; very common values are left to the skew handling of the join. Unseen and
    missing values have no place. Rows keep their other columns.
    """
    dictionary = label_dictionary(train, columns)

    def encode(df: DataFrame) -> DataFrame:
        for i, c in enumerate(columns):
            places = dictionary.where(F.col("column") == c)
            places = places.select(F.col("value").alias(f"__value_{i}"), F.col("slot").alias(f"{c}_slot"))
            df = df.join(places, F.col(f"`{c}`").cast("string") == F.col(f"__value_{i}"), "left").drop(f"__value_{i}")
        return df.drop(*columns)

    return [encode(df) for df in (train, *others)]


def robust_stats(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """One row with `[q25, median, q75]`, min and max of each column.

    The edges come from the pass that makes the sketches; one more pass finds the
    exact quantiles. NaN ranks above all numbers.
    """
    probs = (0.25, 0.5, 0.75)
    first = df.agg(
        *sketches(columns, probs, **options),
        *[F.min(c).cast("double").alias(f"__min_{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("double").alias(f"__max_{i}") for i, c in enumerate(columns)],
    ).first()
    q = refine(df, first, [], columns, probs).first() or [None] * len(columns)
    fields = ("q25", "median", "q75", "min", "max")
    values = [
        v
        for i in range(len(columns))
        for v in (*(q[i] or [None] * 3), first[f"__min_{i}"], first[f"__max_{i}"])
    ]
    schema = T.StructType(
        [T.StructField(f"{c}_{f}", T.DoubleType()) for c in columns for f in fields]
    )
    return df.sparkSession.createDataFrame([tuple(values)], schema)


def robust_smooth_clip(
    train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str], **options
) -> list[DataFrame]:
    """Median-centred, range-scaled and smoothly clipped into (-3, 3); missing gives 0.

    The scale is the interquartile range, half the full range where that is
    zero, and nothing at all for a constant column.
    """
    stats = robust_stats(train, columns, **options).first()

    def scaled(c):
        if stats[f"{c}_median"] is None:
            return F.lit(0.0)
        spread = stats[f"{c}_q75"] - stats[f"{c}_q25"]
        if spread == 0.0:
            spread = 0.5 * (stats[f"{c}_max"] - stats[f"{c}_min"])
        factor = 0.0 if spread == 0.0 else 1.0 / (spread + 1e-30)
        z = (F.col(c).cast("double") - F.lit(stats[f"{c}_median"])) * F.lit(factor)
        clipped = z / F.sqrt(F.lit(1.0) + F.pow(z / F.lit(3.0), F.lit(2)))
        return F.coalesce(F.nanvl(clipped, F.lit(0.0)), F.lit(0.0))

    return [df.withColumns({c: scaled(c) for c in columns}) for df in (train, *others)]


def target_moments(train: DataFrame, target: str) -> tuple[float, float]:
    row = train.agg(F.avg(target).alias("m"), F.stddev_pop(target).alias("s")).first()
    return row["m"], row["s"]


def standardize_target(
    train: DataFrame, others: Sequence[DataFrame], target: str
) -> tuple[list[DataFrame], tuple[float, float]]:
    """Target minus the train mean over the train population std, and both numbers."""
    mean, std = target_moments(train, target)
    z = (F.col(target) - F.lit(mean)) / F.lit(std + 1e-30)
    return [df.withColumn(target, z) for df in (train, *others)], (mean, std)


def unstandardize(pred: Column, moments: tuple[float, float]) -> Column:
    mean, std = moments
    return pred * F.lit(std) + F.lit(mean)

