"""Quadratic-weighted kappa as plain aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordina.config import N_CLASSES
from ordina.functions.classes import ordinal_decode, round_half_even, round_to_class
from ordina.operators.ranking import prefix_starts

CELLS = "__cell_{}_{}"


def kappa_from_sums(n: Column, t: Column, p: Column, tt: Column, pp: Column, tp: Column) -> Column:
    """Kappa from counts and moments; null where it is undefined."""
    observed = tt + pp - F.lit(2) * tp
    expected = (tt + pp).cast("double") - F.lit(2.0) * F.try_divide(
        (t * p).cast("double"), n.cast("double")
    )
    return F.lit(1.0) - F.try_divide(observed.cast("double"), expected)


def cell_counts(y: Column, p: Column, n_classes: int, weight: Column | None = None) -> list[Column]:
    """Aggregates for the `n_classes` squared cells of the confusion matrix."""
    one = F.lit(1) if weight is None else weight
    return [
        F.coalesce(F.sum(F.when((y == i) & (p == j), one)), F.lit(0)).alias(CELLS.format(i, j))
        for i in range(n_classes)
        for j in range(n_classes)
    ]


def kappa_of_cells(df: DataFrame, n_classes: int, out: str = "qwk") -> DataFrame:
    """Replace the cell columns of each row by its kappa.

    Weights are distances between positions in the sorted union of the labels
    that occur, so a class absent from both sides takes no position.
    """
    grid = range(n_classes)
    keep = [c for c in df.columns if not c.startswith("__cell_")]

    def cell(i, j):
        return F.col(CELLS.format(i, j))

    def total(columns):
        first, *rest = columns
        for c in rest:
            first = first + c
        return first

    margins = df.select(
        "*",
        *[total([cell(i, j) for j in grid]).alias(f"__row_{i}") for i in grid],
        *[total([cell(i, j) for i in grid]).alias(f"__col_{j}") for j in grid],
    )
    present = [((F.col(f"__row_{i}") + F.col(f"__col_{i}")) > 0).cast("bigint") for i in grid]
    # The first class has position 0 and adds to none of the sums but the count.
    moved = grid[1:]
    placed = margins.select("*", *[total(present[:i]).alias(f"__pos_{i}") for i in moved])
    pos = [F.col(f"__pos_{i}") if i else None for i in grid]
    row = [F.col(f"__row_{i}") for i in grid]
    col = [F.col(f"__col_{i}") for i in grid]
    weighted = [total([pos[j] * cell(i, j) for j in moved]) for i in grid]
    sums = placed.select(
        *keep,
        total(row).alias("__n"),
        total([pos[i] * row[i] for i in moved]).alias("__t"),
        total([pos[i] * col[i] for i in moved]).alias("__p"),
        total([pos[i] * pos[i] * row[i] for i in moved]).alias("__tt"),
        total([pos[i] * pos[i] * col[i] for i in moved]).alias("__pp"),
        total([pos[i] * weighted[i] for i in moved]).alias("__tp"),
    )
    moments = [F.col(f"__{m}") for m in ("n", "t", "p", "tt", "pp", "tp")]
    return sums.select(*keep, kappa_from_sums(*moments).alias(out))


def qwk_classes(
    df: DataFrame,
    y: Column,
    p: Column,
    by: Sequence[str] = (),
    n_classes: int = N_CLASSES,
    out: str = "qwk",
) -> DataFrame:
    """Kappa of classes `0..n_classes-1` in one aggregate; other classes are an error."""
    known = y.between(0, n_classes - 1) & p.between(0, n_classes - 1)
    checked = df.groupBy(*by).agg(
        *cell_counts(y, p, n_classes), F.count_if(~F.coalesce(known, F.lit(False))).alias("__odd")
    )
    checked = checked.where(
        F.when(F.col("__odd") == 0, F.lit(True)).otherwise(
            F.raise_error(F.lit("a class lies outside the known range")).cast("boolean")
        )
    ).drop("__odd")
    return kappa_of_cells(checked, n_classes, out)


def qwk(
    df: DataFrame, y: Column, p: Column, by: Sequence[str] = (), out: str = "qwk"
) -> DataFrame:
    """Kappa of integer labels of any range.

    Rows are first reduced to one count per pair of labels; positions come from
    ranking the labels that occur on either side.
    """
    by = list(by)
    pairs = df.groupBy(*by, y.alias("__y"), p.alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    labels = pairs.select(*by, F.explode(F.array("__y", "__l")).alias("__label")).distinct()
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("__label")) - 1
        ranked = labels.withColumn("__pos", place)
    else:
        ranked = prefix_starts(labels.withColumn("__one", F.lit(1)), ["__label"], "__one")
        ranked = ranked.withColumnRenamed("__start", "__pos")
    at_y = ranked.select(*by, F.col("__label").alias("__y"), F.col("__pos").alias("__t"))
    at_p = ranked.select(*by, F.col("__label").alias("__l"), F.col("__pos").alias("__p"))
    n, t, p_ = F.col("__n"), F.col("__t"), F.col("__p")
    sums = (
        pairs.join(at_y, [*by, "__y"])
        .join(at_p, [*by, "__l"])
        .groupBy(*by)
        .agg(
            *[
                F.sum(v).alias(name)
                for name, v in (
                    ("n", n),
                    ("t", n * t),
                    ("p", n * p_),
                    ("tt", n * t * t),
                    ("pp", n * p_ * p_),
                    ("tp", n * t * p_),
                )
            ]
        )
    )
    moments = [F.col(m) for m in ("n", "t", "p", "tt", "pp", "tp")]
    return sums.select(*by, kappa_from_sums(*moments).alias(out))


def qwk_threshold(
    df: DataFrame, y: str, pred: str, thresholds: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Kappa of the classes that a threshold tuple makes of a score."""
    return qwk_classes(
        df,
        round_half_even(y),
        round_to_class(pred, thresholds),
        by,
        n_classes=len(thresholds) + 1,
    )


def qwk_round(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Kappa of the score rounded half to even."""
    return qwk(df, round_half_even(y), round_half_even(pred), by)


def qwk_ordinal(df: DataFrame, y: str, scores: str, by: Sequence[str] = ()) -> DataFrame:
    """Kappa of two ordinal vectors, each decoded to its class."""
    return qwk(df, ordinal_decode(y), ordinal_decode(scores), by)


# --- pluggable metrics -------------------------------------------------------


@dataclass(frozen=True)
class Metric:
    """A metric of target and score that can be grouped.

    `parts` gives the aggregates it needs, `finish` turns the columns of these
    aggregates into one column and keeps the others.
    """

    parts: Callable[[Column, Column], list[Column]]
    finish: Callable[[DataFrame, str], DataFrame]


def column_metric(how: Callable[[Column, Column], Column]) -> Metric:
    """A metric given as one aggregate of (target, score)."""
    return Metric(
        lambda y, p: [how(y, p).alias("__metric")],
        lambda df, out: df.withColumnRenamed("__metric", out),
    )


def squared_error() -> Metric:
    return column_metric(lambda y, p: F.avg(F.pow(y.cast("double") - p, F.lit(2))))


def threshold_kappa(thresholds: Sequence[float]) -> Metric:
    n = len(thresholds) + 1
    return Metric(
        lambda y, p: cell_counts(round_half_even(y), round_to_class(p, thresholds), n),
        lambda df, out: kappa_of_cells(df, n, out),
    )


def rounded_kappa(low: int = -2, high: int = N_CLASSES + 1) -> Metric:
    """Kappa of scores rounded half to even; labels outside `low..high` are an error."""
    n = high - low + 1

    def parts(y: Column, p: Column) -> list[Column]:
        a, b = round_half_even(y) - low, round_half_even(p) - low
        known = F.coalesce(a.between(0, n - 1) & b.between(0, n - 1), F.lit(False))
        return [*cell_counts(a, b, n), F.count_if(~known).alias("__odd")]

    def finish(df: DataFrame, out: str) -> DataFrame:
        fits = F.when(F.col("__odd") == 0, F.lit(True))
        fails = F.raise_error(F.lit("a class lies outside the known range")).cast("boolean")
        return kappa_of_cells(df.where(fits.otherwise(fails)).drop("__odd"), n, out)

    return Metric(parts, finish)
