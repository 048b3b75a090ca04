"""Exact quantiles of groups of any size."""

from __future__ import annotations

import math
import sys
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ordina.session import written

ACCURACY = 1_000
SLICES = 1024
# A group gets one more cell for each so many rows, and all groups together at most
# MAX_CELLS of them.
ROWS_PER_CELL = 1_000_000
MAX_CELLS = 4_096


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float] = (0.5,),
    spread_by: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Per group one array of linearly interpolated quantiles for each column.

    Nulls are ignored; NaN ranks above all numbers; a column without values gives
    null. Groups whose key is null are left out.

    A mergeable sketch brackets each wanted rank and `refine` finds the exact values,
    whatever the size of the input. Medians of groups below `accuracy` / 2 rows are exact
    in the sketch already, whose error is less than a rank there.
    """
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    table = df.groupBy(*keys).agg(*sketches(columns, probs, accuracy))
    if keys:
        table = written(table, "sketch")
    return refine(df, table, keys, columns, probs, spread_by)


def _finite(value: Column) -> Column:
    """The value, with infinities and NaN moved to the ends of the finite range.

    No two values change their order. Sketches and slices cannot deal with NaN and
    infinities; they only need values in the right order.
    """
    top = F.lit(sys.float_info.max)
    return F.when(value.isNotNull(), F.greatest(F.least(value, top), -top))


# Added to 1/2, the rank after that of 1/2 in any group that the sketch holds whole.
NEXT = 1e-7


def _margins(accuracy: int, probs: Sequence[float]) -> list[float]:
    """Half widths of brackets, as shares of a group: twice the sketch's error, doubled up to all.

    Medians need two: below `accuracy` / 2 rows they need none, above it twice the error
    or four times holds the rank.
    """
    margins = [2.0 / accuracy]
    while margins[-1] < 1.0 and (len(margins) < 2 or tuple(probs) != (0.5,)):
        margins.append(min(1.0, 2 * margins[-1]))
    return margins


def sketches(
    columns: Sequence[str], probs: Sequence[float] = (0.5,), accuracy: int = ACCURACY
) -> list[Column]:
    """Aggregates that bracket every wanted rank, one struct `__sketch_<i>` per column.

    `cuts` has for each probability the values of the ranks that it means in a group which
    the sketch holds whole, then the lower and upper cut of every margin.
    """
    cuts = []
    for p in probs:
        cuts += [p, min(1.0, p + NEXT)]
        for margin in _margins(accuracy, probs):
            cuts += [max(0.0, p - margin), min(1.0, p + margin)]
    return [
        F.struct(
            F.count(c).alias("n"),
            F.lit(accuracy).alias("accuracy"),
            F.percentile_approx(_finite(F.col(c).cast("double")), cuts, accuracy).alias("cuts"),
        ).alias(f"__sketch_{i}")
        for i, c in enumerate(columns)
    ]


def _whole(sketch: Column, prob: float) -> Column:
    """Whether the sketch has the exact ranks of this probability.

    Its error is below half a rank; for other probabilities than 1/2 no fixed cuts meet
    the ranks of interpolation in groups of every size.
    """
    return (F.lit(2) * sketch["n"] < sketch["accuracy"]) & F.lit(prob == 0.5)


def _bracket(sketch: Column, q: int, prob: float, n_cuts: Column) -> tuple[Column, Column]:
    """Lower and upper cut around probability number `q`.

    A margin holds the rank if it exceeds the sketch's error by 1 / n, since ranks count
    from 0 to n - 1 here and from 1 to n in the sketch.
    """
    n, accuracy, levels = sketch["n"], sketch["accuracy"], n_cuts / 2 - 1
    # margin_j = 2 ** (j + 1) / accuracy >= 1 / accuracy + 1 / n
    needed = F.ceil(F.log2((F.lit(1.0) + accuracy / F.greatest(n, F.lit(1))) / 2))
    level = F.lit(1) + F.greatest(F.lit(0), F.least(levels - 1, needed))
    level = F.when(_whole(sketch, prob), F.lit(0)).otherwise(level)
    at = (F.lit(q) * n_cuts + F.lit(2) * level).cast("int")
    return F.get(sketch["cuts"], at), F.get(sketch["cuts"], at + 1)


def _extreme(cut: Column) -> Column:
    """Whether a cut stands for infinities and NaN too."""
    return F.abs(cut) == F.lit(sys.float_info.max)


def _interpolated(low: Column, high: Column, part: Column) -> Column:
    gap = high - low
    return (
        F.when(low == high, low)
        .when(_finite(gap) == gap, low + gap * part)
        .otherwise(low * (1 - part) + high * part)
    )


def _with_bounds(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    spread_by: Sequence[str],
) -> DataFrame:
    """Rows next to the sketches of their group.

    The join is left to the optimizer. Groups above ROWS_PER_CELL rows are cut into
    cells by a salt, as many as their sketch counts ask for; other groups have one
    cell. The salt is a hash of the row's own values, so a task that runs again puts
    each row where it was.
    """
    names = [f"__sketch_{i}" for i in range(len(columns))]
    size = F.greatest(F.lit(0), *[F.col(n)["n"] for n in names])
    table = table.select(*keys, *names).withColumn("__rows", size)
    total = table.agg(F.sum("__rows")).first()[0] or 0
    per_cell = max(ROWS_PER_CELL, total // MAX_CELLS)
    cells = (F.ceil(F.col("__rows") / F.lit(per_cell))).cast("int")
    # At most MAX_CELLS groups have more than `per_cell` rows.
    hot = table.where(F.col("__rows") > per_cell).select(*keys, cells.alias("__cells"))
    rows = df.select(*keys, *columns, *[c for c in spread_by if c not in (*keys, *columns)])
    salt = F.pmod(F.xxhash64(*dict.fromkeys([*columns, *spread_by])), F.coalesce("__cells", F.lit(1)))
    rows = rows.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", salt.cast("int"))
    copies = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), cells) - 1)))
    return rows.select(*keys, *columns, "__salt").join(copies.drop("__rows"), [*keys, "__salt"])


def refine(
    df: DataFrame,
    table: DataFrame | Row,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float] = (0.5,),
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles from the rows and the table of their groups' sketches.

    Without keys the table may be its one row. With keys, groups whose sketches hold all
    wanted ranks are read off; the rows of the others are passed over again.
    """
    keys, columns, probs = list(keys), list(columns), list(probs)
    names = [f"__sketch_{i}" for i in range(len(columns))]
    if not keys:
        only = table.first() if isinstance(table, DataFrame) else table
        values = _of_whole_table(df, [only[name] for name in names], columns, probs)
        schema = ", ".join(f"`{c}` array<double>" for c in columns)
        return df.sparkSession.createDataFrame([tuple(values)], schema)

    bounds = [F.col(name) for name in names]
    read, whole = [], F.lit(True)
    for bound in bounds:
        values = []
        for q, p in enumerate(probs):
            low, high = _bracket(bound, q, p, F.size(bound["cuts"]) / F.lit(len(probs)))
            done = _whole(bound, p) & ~_extreme(low) & ~_extreme(high)
            whole = whole & ((bound["n"] == 0) | F.coalesce(done, F.lit(False)))
            at = F.lit(float(p)) * (bound["n"] - 1)
            values.append(_interpolated(low, high, at - F.floor(at)))
        read.append(F.when(bound["n"] > 0, F.array(*values)))
    held = table.where(whole).select(*keys, *[v.alias(c) for v, c in zip(read, columns)])
    open_ = table.where(~whole)
    if open_.isEmpty():
        return held
    rows = _with_bounds(df, open_, keys, columns, spread_by)
    found = _ranked(rows, bounds, keys, columns, probs)
    return held.unionByName(open_.select(*keys).join(found, keys, "left"))


def _tests(place: Column, low: Column, high: Column) -> dict[str, Column]:
    """Where a value lies; an end that stands for several values is ranked with what lies between."""
    at_low = (place == low) & ~_extreme(low)
    at_high = (place == high) & (high > low) & ~_extreme(high)
    between = F.coalesce((place >= low) & (place <= high) & ~at_low & ~at_high, F.lit(False))
    return {"below": place < low, "low": at_low, "between": between, "high": at_high}


def _known_tests(value: Column, low: float, high: float) -> dict[str, Column]:
    """`_tests` for ends that are known beforehand, without those that no value passes.

    An end that stands for several values has nothing beyond it.
    """
    top = sys.float_info.max
    if low == high and abs(low) < top:
        return {"below": value < low, "low": value == low}
    tests = {}
    if low > -top:
        tests = {"below": value < low, "low": value == low}
    if high < top:
        tests["high"] = value == high
    above = value > low if low > -top else value.isNotNull()
    tests["between"] = above & (value < high) if high < top else above
    return tests


def _place(column: str) -> Column:
    return _finite(F.col(column).cast("double"))


def _counted(
    rows: DataFrame, brackets: dict[tuple[int, int], tuple[Column, Column]], keys: list[str], columns: list[str]
) -> DataFrame:
    """Values between the ends of the brackets: (keys, column, prob, slice, value, n)."""
    candidates, inside = [], []
    for (i, q), (low, high) in brackets.items():
        place = _place(columns[i])
        # Halves, since the whole range may be wider than a double.
        width = high / 2 - low / 2
        slice_ = F.when(width > 0, F.floor((place / 2 - low / 2) / width * F.lit(SLICES)))
        inside.append(_tests(place, low, high)["between"])
        entry = F.struct(
            F.lit(i).alias("column"),
            F.lit(q).alias("prob"),
            F.coalesce(slice_, F.lit(0)).alias("slice"),
            F.col(columns[i]).cast("double").alias("value"),
        )
        candidates.append(F.when(inside[-1], entry))
    counted = (
        rows.where(reduce(or_, inside))
        .select(*keys, F.explode(F.array(*candidates)).alias("c"))
        .where(F.col("c").isNotNull())
        .select(*keys, "c.*")
        .groupBy(*keys, "column", "prob", "slice", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Small next to the input and read twice, so it is written, not computed twice.
    return written(counted, "ranks")


def _picked(counted: DataFrame, marks: DataFrame, cell: list[str]) -> DataFrame:
    """Per cell the values of its ranks `first` and `last` among the counted ones."""
    earlier = Window.partitionBy(*cell).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = counted.groupBy(*cell, "slice").agg(F.sum("n").alias("m"))
    starts = slices.withColumn("start", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    holds = [
        (F.col("start") < F.col(r)) & (F.col(r) <= F.col("start") + F.col("m"))
        for r in ("first", "last")
    ]
    targets = starts.join(marks.select(*cell, "first", "last"), cell).where(holds[0] | holds[1]).drop("m")
    upto = (
        Window.partitionBy(*cell, "slice")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.join(targets, [*cell, "slice"]).withColumn(
        "upto", F.col("start") + F.sum("n").over(upto)
    )
    return ranked.groupBy(*cell).agg(
        F.min(F.when(F.col("upto") >= F.col("first"), F.col("value"))).alias("from_first"),
        F.min(F.when(F.col("upto") >= F.col("last"), F.col("value"))).alias("from_last"),
    )


def _of_whole_table(df: DataFrame, found: list[Row], columns: list[str], probs: list[float]) -> list:
    """Quantiles of every column of `df` from the sketches of the whole table.

    The brackets are a few numbers, literals of the passes over the rows: one counts the
    values on both sides and at the ends of every bracket, and only if a rank lies between
    its ends, another one counts the values there.
    """
    brackets, below = {}, []
    for i, sketch in enumerate(found):
        width = len(sketch["cuts"] or ()) // len(probs)
        for q in range(len(probs) if sketch["n"] else 0):
            needed = math.ceil(math.log2((1.0 + sketch["accuracy"] / sketch["n"]) / 2))
            level = 1 + max(0, min(width // 2 - 2, needed))
            if probs[q] == 0.5 and 2 * sketch["n"] < sketch["accuracy"]:
                level = 0
            at = q * width + 2 * level
            brackets[i, q] = (sketch["cuts"][at], sketch["cuts"][at + 1])
    for (i, q), (low, high) in brackets.items():
        tests = _known_tests(F.col(columns[i]).cast("double"), low, high)
        below += [F.count_if(test).alias(f"{name}_{i}_{q}") for name, test in tests.items()]
    sizes = defaultdict(int, df.agg(*below).first().asDict() if below else {})
    ranks, open_ = {}, []
    for i, q in brackets:
        at = probs[q] * (found[i]["n"] - 1)
        before = sizes[f"below_{i}_{q}"] + sizes[f"low_{i}_{q}"]
        ranks[i, q] = (at, math.floor(at) + 1 - before, math.ceil(at) + 1 - before)
        if any(1 <= r <= sizes[f"between_{i}_{q}"] for r in ranks[i, q][1:]):
            open_.append((i, q))
    picked = {}
    if open_:
        spark, cell = df.sparkSession, ["column", "prob"]
        counted = _counted(df, {at: tuple(map(F.lit, brackets[at])) for at in open_}, [], columns)
        marks = spark.createDataFrame([(*at, *ranks[at][1:]) for at in open_], "column int, prob int, first long, last long")
        picked = {(r["column"], r["prob"]): r for r in _picked(counted, marks, cell).collect()}

    def value_of(at: tuple[int, int], rank: int, name: str) -> float:
        low, between, high = (sizes[f"{part}_{at[0]}_{at[1]}"] for part in ("low", "between", "high"))
        if -low < rank <= 0:
            return brackets[at][0]
        if 1 <= rank <= between:
            return picked[at][f"from_{name}"]
        if between < rank <= between + high:
            return brackets[at][1]
        raise ValueError("a quantile lies outside its sketch bracket")

    def exact(at: tuple[int, int]) -> float:
        place, first, last = ranks[at]
        low, high, part = value_of(at, first, "first"), value_of(at, last, "last"), place % 1
        if low == high:
            return low
        return low + (high - low) * part if math.isfinite(high - low) else low * (1 - part) + high * part

    return [[exact((i, q)) for q in range(len(probs))] if sketch["n"] else None for i, sketch in enumerate(found)]


def _ranked(
    rows: DataFrame, bounds: list[Column], keys: list[str], columns: list[str], probs: list[float]
) -> DataFrame:
    """Exact quantiles of rows that stand next to their sketches.

    Values below a bracket, at its lower and at its upper end are only counted, and so is a
    bracket without width. The values between the ends are counted by value and by even
    slices of the bracket. The slice that holds a wanted rank follows from the slice
    counts, and only the values of that slice are ranked.
    """
    brackets = {
        (i, q): _bracket(bounds[i], q, probs[q], F.size(bounds[i]["cuts"]) / F.lit(len(probs)))
        for i in range(len(columns))
        for q in range(len(probs))
    }
    counts = []
    for (i, q), (low, high) in brackets.items():
        tests = _tests(_place(columns[i]), low, high)
        counts += [F.count_if(test).alias(f"__{name}_{i}_{q}") for name, test in tests.items()]
        counts += [F.max(low).alias(f"__from_{i}_{q}"), F.max(high).alias(f"__to_{i}_{q}")]
    counted = _counted(rows, brackets, keys, columns)
    cell = [*keys, "column", "prob"]
    sizes = rows.groupBy(*keys).agg(
        *counts, *[F.max(b["n"]).alias(f"__size_{i}") for i, b in enumerate(bounds)]
    )
    marks = sizes.select(
        *keys,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("column"),
                        F.lit(q).alias("prob"),
                        (F.lit(float(probs[q])) * (F.col(f"__size_{i}") - 1)).alias("at"),
                        *[F.col(f"__{c}_{i}_{q}").alias(c) for c in ("below", "low", "between", "high", "from", "to")],
                        F.col(f"__size_{i}").alias("size"),
                    )
                    for i, q in brackets
                ]
            )
        ).alias("m"),
    ).select(*keys, "m.*")
    # Ranks among the values between the ends; those up to 0 are the lower end.
    before = F.col("below") + F.col("low")
    marks = marks.where(F.col("size") > 0).select(
        *cell,
        "at",
        (F.floor("at") + 1 - before).alias("first"),
        (F.ceil("at") + 1 - before).alias("last"),
        *[F.col(c).alias(f"__{c}") for c in ("low", "between", "high", "from", "to")],
    )
    marks = written(marks, "marks")

    def value_of(rank: str) -> Column:
        at = F.col(rank)
        return (
            F.when((at <= 0) & (at > -F.col("__low")), F.col("__from"))
            .when((at >= 1) & (at <= F.col("__between")), F.col(f"from_{rank}"))
            .when((at > F.col("__between")) & (at <= F.col("__between") + F.col("__high")), F.col("__to"))
        )

    part = F.col("at") - F.floor("at")
    low, high = value_of("first"), value_of("last")
    outside = F.raise_error(F.lit("a quantile lies outside its sketch bracket")).cast("double")
    exact = F.when(low.isNotNull() & high.isNotNull(), _interpolated(low, high, part)).otherwise(outside)
    values = marks.join(_picked(counted, marks, cell), cell, "left").select(*cell, exact.alias("value"))
    arrays = [_array_of(i, len(probs)).alias(c) for i, c in enumerate(columns)]
    return values.groupBy(*keys).agg(*arrays)


def _array_of(column: int, n_probs: int) -> Column:
    values = [
        F.max(F.when((F.col("column") == column) & (F.col("prob") == q), F.col("value")))
        for q in range(n_probs)
    ]
    return F.when(values[0].isNotNull(), F.array(*values))

