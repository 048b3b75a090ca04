"""Per-subject summary of the sensor series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.config import (
    ANCHOR_DAYS,
    NON_WEAR,
    PLANAR_NORM,
    REL_DAY,
    SAMPLES_PER_DAY,
    SERIES_PREFIX,
    SIGNALS,
)
from ordina.functions.features import feat_norm2d
from ordina.operators.quantiles import refine, sketches
from ordina.session import written


def filter_near_anchor(
    df: DataFrame, rel_day_col: str = REL_DAY, days: float = ANCHOR_DAYS
) -> DataFrame:
    """Samples within `days` of the anchor, as a range the parquet scan can use."""
    return df.where(F.col(rel_day_col).between(-days, days))


def filter_worn(df: DataFrame, flag_col: str = NON_WEAR) -> DataFrame:
    return df.where(F.col(flag_col) == 0)


def with_planar_norm(df: DataFrame, x: str = "X", y: str = "Y") -> DataFrame:
    return df.withColumn(PLANAR_NORM, feat_norm2d(x, y))


def series_summary(
    df: DataFrame,
    id_col: str = "id",
    signals: Sequence[str] = (*SIGNALS, PLANAR_NORM),
    flag_col: str = NON_WEAR,
    day_col: str = REL_DAY,
    mean_cols: Sequence[str] = ("weekday", "quarter"),
    per_day: int = SAMPLES_PER_DAY,
    prefix: str = SERIES_PREFIX,
) -> DataFrame:
    """min, max, mean, std, median of the worn samples plus wear and coverage.

    Three passes shuffle partial results only, so an id with any share of the rows
    is no problem: the algebraic part with the median sketches (written to the shared
    folder), the days per id (grouped by day first, so no task holds a set of
    days) and the exact medians. NaN ranks above all numbers; a null day is a day.
    """
    df = df.where(F.col(id_col).isNotNull())
    worn = F.col(flag_col) == 0
    medians = [f"__median_{i}" for i in range(len(signals))]
    samples = df.select(
        id_col,
        flag_col,
        day_col,
        *mean_cols,
        *[c for c in ("time_of_day",) if c in df.columns],
        *[F.when(worn, F.col(s)).cast("double").alias(m) for s, m in zip(signals, medians)],
    )
    is_worn = F.coalesce(worn.cast("int"), F.lit(0))
    parts = {s: F.col(m) for s, m in zip(signals, medians)}
    stats = [
        how(x).alias(f"{prefix}{s}_{name}")
        for name, how in (
            ("min", F.min),
            ("max", F.max),
            ("mean", F.avg),
            ("std", F.stddev_samp),
        )
        for s, x in parts.items()
    ]
    plain = [
        F.avg(F.col(flag_col).cast("double")).alias(f"{prefix}{flag_col}_mean"),
        F.count(flag_col).alias("__flags"),
        *[F.avg(F.col(c).cast("double")).alias(f"{prefix}{c}_mean") for c in mean_cols],
    ]
    base = written(samples.groupBy(id_col).agg(*stats, *plain, *sketches(medians)), "series-base")
    days = (
        samples.groupBy(id_col, day_col)
        .agg(F.max(is_worn).alias("worn"))
        .groupBy(id_col)
        .agg(F.count(F.lit(1)).alias("__days"), F.sum("worn").alias("__worn_days"))
    )
    spread_by = [day_col, *[c for c in ("time_of_day",) if c in samples.columns]]
    middle = refine(samples, base, [id_col], medians, spread_by=spread_by)
    middle = middle.select(id_col, *[F.get(m, F.lit(0)).alias(m) for m in medians])
    grouped = base.join(days, id_col).join(middle, id_col)

    ordered = [
        F.col(f"{prefix}{s}_{name}") for name in ("min", "max", "mean", "std") for s in signals
    ]
    return grouped.select(
        id_col,
        *ordered,
        *[F.col(m).alias(f"{prefix}{s}_median") for s, m in zip(signals, medians)],
        F.col("__worn_days").cast("bigint").alias(f"{prefix}total_day_registered"),
        F.col(f"{prefix}{flag_col}_mean"),
        (F.col("__flags") / (F.lit(float(per_day)) * F.col("__days"))).alias(
            f"{prefix}missing_data_mean"
        ),
        *[F.col(f"{prefix}{c}_mean") for c in mean_cols],
    )


def join_series(base: DataFrame, summary: DataFrame, id_col: str = "id") -> DataFrame:
    """Subjects keep their row; without a device all series columns are null."""
    return base.join(summary, id_col, "left")


def series_subset(df: DataFrame, prefix: str = SERIES_PREFIX) -> DataFrame:
    """Rows with at least one series column present."""
    present = [F.col(c).cast("double") for c in df.columns if c.startswith(prefix)]
    return df.where(F.coalesce(*present).isNotNull())
