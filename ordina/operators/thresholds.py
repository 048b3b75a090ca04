"""Threshold grids and the search for the best tuple."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.config import BASE_THRESHOLDS, THRESHOLD_HALF_WIDTH, THRESHOLD_POINTS
from ordina.functions.features import linspace
from ordina.operators.metrics import CELLS, kappa_from_sums, kappa_of_cells
from ordina.session import written


@dataclass(frozen=True)
class ThresholdGrid:
    """Threshold tuples to try, in order.

    The product of the axes, or the rising tuples of the first axis when
    `rising` is set; `base`, if given, is one more tuple behind all others.
    """

    axes: tuple[tuple[float, ...], ...]
    base: tuple[float, ...] | None = None
    rising: bool = False

    @property
    def values(self) -> list[float]:
        """All thresholds that occur, sorted, each once."""
        return sorted({v for axis in self.axes for v in axis} | set(self.base or ()))

    @property
    def names(self) -> list[str]:
        return [f"t{i + 1}" for i in range(len(self.axes))]

    def rows(self, spark: SparkSession) -> DataFrame:
        """`(combo, t1, t2, ...)`, generated from the tuple number without a join."""
        table = self._numbered(spark)
        return table.select("combo", *[F.col(f"__v{i}").alias(n) for i, n in enumerate(self.names)])

    def _numbered(self, spark: SparkSession) -> DataFrame:
        """Tuples with their values `__v<i>` and positions `__at<i>` in `values`."""
        sizes = [len(a) for a in self.axes]
        total = math.prod(sizes)
        place = {v: i for i, v in enumerate(self.values)}
        columns, stride = [], total
        for i, (axis, size) in enumerate(zip(self.axes, sizes)):
            stride //= size
            digit = f"CAST((id div {stride}L) % {size}L AS INT)"
            value = f"get({_literals(axis)}, {digit})"
            at = f"get(array({', '.join(str(place[v]) for v in axis)}), {digit})"
            if self.base is not None:
                last = self.base[i]
                value = f"CASE WHEN id = {total}L THEN {last!r}D ELSE {value} END"
                at = f"CASE WHEN id = {total}L THEN {place[last]} ELSE {at} END"
            columns += [f"{value} AS __v{i}", f"{at} AS __at{i}"]
        ids = spark.range(total + (self.base is not None))
        table = ids.selectExpr("id AS combo", *columns)
        if self.rising:
            pairs = zip(range(len(self.axes)), range(1, len(self.axes)))
            keep = reduce(and_, [F.col(f"__at{a}") < F.col(f"__at{b}") for a, b in pairs])
            table = table.where(keep if self.base is None else keep | (F.col("combo") == total))
        return table


def _literals(values: Sequence[float]) -> str:
    return f"array({', '.join(f'{v!r}D' for v in values)})"


def grid_cross(
    base: Sequence[float] = BASE_THRESHOLDS,
    half_width: float = THRESHOLD_HALF_WIDTH,
    points: int = THRESHOLD_POINTS,
) -> ThresholdGrid:
    """All tuples from one axis around each base threshold, and the base itself."""
    axes = tuple(tuple(linspace(b - half_width, b + half_width, points)) for b in base)
    return ThresholdGrid(axes, tuple(float(b) for b in base))


def grid_combinations(
    low: float, high: float, points: int = 50, size: int = 3
) -> ThresholdGrid:
    """All strictly rising tuples of evenly spaced thresholds."""
    axis = tuple(linspace(low, high, points))
    return ThresholdGrid((axis,) * size, rising=True)


def threshold_grid(
    spark: SparkSession,
    base: Sequence[float] = BASE_THRESHOLDS,
    half_width: float = THRESHOLD_HALF_WIDTH,
    points: int = THRESHOLD_POINTS,
) -> DataFrame:
    return grid_cross(base, half_width, points).rows(spark)


def pred_ge_threshold(
    df: DataFrame,
    fold: str,
    y: str,
    pred: str,
    values: Sequence[float],
    n_classes: int,
) -> DataFrame:
    """Per fold and threshold, how many rows of each class score at least it.

    Columns `(fold, at, threshold, ge_0, ..., all_0, ...)`. Each row is put once
    into the interval between neighbouring thresholds; the counts per interval
    are summed from the top, so no row is compared with every threshold. Null
    and NaN scores count as above all thresholds.
    """
    values = sorted(set(values))
    inner = "__interval"
    # Adding zero turns -0.0, which the interval search puts below 0.0, into 0.0.
    score = F.coalesce(F.col(pred).cast("double") + F.lit(0.0), F.lit(float("nan")))
    scored = df.select(fold, F.col(y).cast("int").alias("__y"), score.alias("__score"))
    intervals = Bucketizer(
        splits=[float("-inf"), *values, float("inf")],
        inputCol="__score",
        outputCol=inner,
        handleInvalid="keep",
    ).transform(scored)
    interval = F.least(F.col(inner), F.lit(float(len(values)))).cast("int")
    counted = intervals.groupBy(fold, interval.alias("__at")).agg(
        *[F.count_if(F.col("__y") == i).alias(f"__n_{i}") for i in range(n_classes)],
        F.count_if(~F.coalesce(F.col("__y").between(0, n_classes - 1), F.lit(False))).alias(
            "__odd"
        ),
    )
    counted = counted.where(
        F.when(F.col("__odd") == 0, F.lit(True)).otherwise(
            F.raise_error(F.lit("a class lies outside the known range")).cast("boolean")
        )
    ).drop("__odd")
    # Interval i holds the scores from threshold i-1 up to threshold i, so a fold
    # has at most one cell more than there are thresholds.
    cells = counted.groupBy(fold).agg(
        F.collect_list(F.struct("__at", *[f"__n_{i}" for i in range(n_classes)])).alias("__cells")
    )
    each = cells.select(
        fold, "__cells", F.explode(F.sequence(F.lit(1), F.lit(len(values)))).alias("__from")
    )

    def total(i, at_least):
        zero = F.lit(0).cast("bigint")
        return F.aggregate(
            "__cells",
            zero,
            lambda acc, c: acc + F.when(c["__at"] >= at_least, c[f"__n_{i}"]).otherwise(zero),
        )

    return each.select(
        fold,
        (F.col("__from") - 1).alias("at"),
        F.element_at(F.expr(_literals(values)), F.col("__from")).alias("threshold"),
        *[total(i, F.col("__from")).alias(f"ge_{i}") for i in range(n_classes)],
        *[total(i, F.lit(0)).alias(f"all_{i}") for i in range(n_classes)],
    )


def _counted(df: DataFrame, fold: str, y: str, pred: str, grid: ThresholdGrid) -> DataFrame:
    """The per-threshold counts, one small row per threshold and fold, written once."""
    n_classes = len(grid.axes) + 1
    counts = pred_ge_threshold(df, fold, y, pred, grid.values, n_classes).drop("threshold")
    return written(counts, "threshold-counts")


def _joined(fold: str, grid: ThresholdGrid, per_at: Sequence[str], counts: DataFrame) -> DataFrame:
    """Tuples joined with the count rows of each of their thresholds.

    The rows are `(fold, at, *per_at, *per_fold)`; `per_at` columns come back
    once per tuple position as `<name>_<position>`. Folds may be many: they are joined
    on `(fold, at)`, and the optimizer picks the way by the size of the counts.
    """
    per_fold = [c for c in counts.columns if c not in (fold, "at", *per_at)]
    # A class needs its own and all lower thresholds passed, so a tuple that is
    # not sorted acts like its running maximum.
    table = grid._numbered(counts.sparkSession)
    for i in range(len(grid.axes)):
        parts = [F.col(f"__at{j}") for j in range(i + 1)]
        reached = F.greatest(*parts) if i else parts[0]
        side = counts.select(
            F.col(fold).alias(fold if i == 0 else f"__fold_{i}"),
            F.col("at").alias(f"__key_{i}"),
            *[F.col(c).alias(f"{c}_{i}") for c in per_at],
            *(per_fold if i == 0 else []),
        )
        on = reached == F.col(f"__key_{i}")
        if i:
            on = on & F.col(fold).eqNullSafe(F.col(f"__fold_{i}"))
        table = table.join(side, on)
    names = [F.col(f"__v{i}").alias(n) for i, n in enumerate(grid.names)]
    made = [f"{c}_{i}" for i in range(len(grid.axes)) for c in per_at]
    return table.select("combo", *names, fold, *made, *per_fold)


def grid_cells(
    df: DataFrame,
    fold: str,
    y: str,
    pred: str,
    grid: ThresholdGrid,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Confusion cells of every tuple and fold: `(combo, t.., fold, cells)`.

    The cost of the grid does not depend on the number of rows: it joins the
    tuples with the per-threshold counts, once for each tuple position.
    """
    n = len(grid.axes) + 1
    counts = _counted(df, fold, y, pred, grid) if counts is None else counts
    table = _joined(fold, grid, [f"ge_{c}" for c in range(n)], counts)
    steps = [
        [F.col(f"all_{c}"), *[F.col(f"ge_{c}_{i}") for i in range(n - 1)], F.lit(0)]
        for c in range(n)
    ]
    return table.select(
        "combo",
        *grid.names,
        fold,
        *[
            (steps[c][p] - steps[c][p + 1]).alias(CELLS.format(c, p))
            for c in range(n)
            for p in range(n)
        ],
    )


def _grid_moments(fold: str, grid: ThresholdGrid, counts: DataFrame) -> DataFrame:
    """Kappa of every tuple and fold when all classes occur in every fold.

    Then a class is its own position, and with `c` rows and label sum `s` at or
    above each threshold the moments are sums over the thresholds: `p` of `c`,
    `p*p` of `(2i+1) c` and `t*p` of `s`.
    """
    n = len(grid.axes) + 1

    def total(name, power):
        return reduce(add, [F.col(f"{name}_{c}") * c**power for c in range(n)])

    lean = counts.select(
        fold,
        "at",
        total("ge", 0).alias("c"),
        total("ge", 1).alias("s"),
        total("all", 0).alias("n"),
        total("all", 1).alias("t"),
        total("all", 2).alias("tt"),
    )
    table = _joined(fold, grid, ["c", "s"], lean)
    at = range(n - 1)
    p = reduce(add, [F.col(f"c_{i}") for i in at])
    pp = reduce(add, [F.col(f"c_{i}") * (2 * i + 1) for i in at])
    tp = reduce(add, [F.col(f"s_{i}") for i in at])
    kappa = kappa_from_sums(F.col("n"), F.col("t"), p, F.col("tt"), pp, tp)
    return table.select("combo", *grid.names, fold, kappa.alias("qwk"))


def grid_scores(
    df: DataFrame, fold: str, y: str, pred: str, grid: ThresholdGrid
) -> DataFrame:
    """Mean over the folds of each tuple's kappa; null if one fold has none."""
    n = len(grid.axes) + 1
    counts = _counted(df, fold, y, pred, grid)
    full = reduce(and_, [F.col(f"all_{c}") > 0 for c in range(n)])
    scored = _grid_moments(fold, grid, counts.where(full))
    partial = counts.where(~full)
    if not partial.isEmpty():
        rest = kappa_of_cells(grid_cells(df, fold, y, pred, grid, partial), n)
        scored = scored.unionByName(rest)
    all_defined = F.count("qwk") == F.count(F.lit(1))
    return scored.groupBy("combo", *grid.names).agg(
        F.when(all_defined, F.avg("qwk")).alias("score")
    )


def argmax_thresholds(scores: DataFrame, digits: int | None = None) -> DataFrame:
    """The best tuple; the first one among equals."""
    score = F.col("score") if digits is None else F.round("score", digits)
    return scores.orderBy(score.desc_nulls_last(), "combo").limit(1)


def threshold_search(
    df: DataFrame,
    fold: str,
    y: str,
    pred: str,
    grid: ThresholdGrid | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Best threshold tuple over all folds as one row `(combo, t1, t2, t3, score)`."""
    return argmax_thresholds(grid_scores(df, fold, y, pred, grid or grid_cross()), digits)


def threshold_gain(best: DataFrame, base_score: Column | float) -> DataFrame:
    """The search result with its gain over the cross-validation score."""
    base = base_score if isinstance(base_score, Column) else F.lit(float(base_score))
    return best.withColumn("gain", F.col("score") - base)
