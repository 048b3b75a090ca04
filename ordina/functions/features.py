"""Row features: each function takes columns and returns one column."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(column: ColumnLike) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _sum(columns: list[Column]) -> Column:
    return reduce(add, columns)


def divide(a: ColumnLike, b: ColumnLike, zero: str = "null") -> Column:
    """`a / b` on doubles.

    `zero="null"` gives null for a zero divisor. `zero="ieee"` gives the signed
    infinities and NaN of floating-point division, so that `inf_count` sees them.
    """
    a, b = _c(a).cast("double"), _c(b).cast("double")
    if zero == "null":
        return F.try_divide(a, b)
    if zero != "ieee":
        raise ValueError(f"unknown zero-division policy {zero!r}")
    at_zero = (
        F.when(a.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(a) | (a == 0), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def feat_coalesce(*columns: ColumnLike) -> Column:
    return F.coalesce(*[_c(c) for c in columns])


def feat_null_count(*columns: ColumnLike) -> Column:
    return _sum([_c(c).isNull().cast("int") for c in columns])


def feat_product(a: ColumnLike, b: ColumnLike) -> Column:
    return _c(a) * _c(b)


def feat_ratio(a: ColumnLike, b: ColumnLike, zero: str = "null") -> Column:
    return divide(a, b, zero)


def feat_ratio_plus1(a: ColumnLike, b: ColumnLike, zero: str = "null") -> Column:
    return divide(a, F.lit(1.0) + _c(b), zero)


def feat_guarded_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """`a / b`, null for a zero divisor whatever the zero-division policy."""
    return divide(a, b, "null")


def feat_pressure(low: ColumnLike, high: ColumnLike) -> Column:
    """`low / ((high - low) / 3)`, null where both are equal."""
    return feat_guarded_ratio(low, (_c(high) - _c(low)).cast("double") / F.lit(3.0))


def feat_diff(a: ColumnLike, b: ColumnLike) -> Column:
    return _c(a) - _c(b)


def feat_min_sec(minutes: ColumnLike, seconds: ColumnLike) -> Column:
    return _c(minutes) * F.lit(60) + _c(seconds)


def feat_sum(*columns: ColumnLike) -> Column:
    """Sum that is null as soon as one part is null."""
    return _sum([_c(c) for c in columns])


def sum_ignoring_nulls(*columns: ColumnLike) -> Column:
    return _sum([F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in columns])


def feat_row_mean(*columns: ColumnLike) -> Column:
    """Mean of the non-null parts; null when all are null."""
    present = _sum([_c(c).isNotNull().cast("int") for c in columns])
    return F.try_divide(sum_ignoring_nulls(*columns), present.cast("double"))


def feat_threshold_sum(
    flagged: list[ColumnLike], plain: list[ColumnLike], at_least: float = 2
) -> Column:
    """Number of `flagged` columns reaching `at_least`, plus the `plain` columns."""
    flags = [(_c(c) >= F.lit(at_least)).cast("int") for c in flagged]
    return _sum(flags + [_c(c).cast("int") for c in plain])


def feat_norm2d(x: ColumnLike, y: ColumnLike) -> Column:
    return F.sqrt(F.pow(_c(x), F.lit(2)) + F.pow(_c(y), F.lit(2)))


def linspace(low: float, high: float, points: int) -> list[float]:
    """Evenly spaced values with both ends exact, as plain floats."""
    if points == 1:
        return [float(low)]
    step = (high - low) / (points - 1)
    return [low + i * step for i in range(points - 1)] + [float(high)]


def linspace_column(low: ColumnLike, high: ColumnLike, points: int) -> Column:
    """The same as an array column, for bounds that are data."""
    low, high = _c(low), _c(high)
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)), lambda i: low + i * (high - low) / (points - 1)
    )
