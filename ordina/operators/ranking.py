"""Running totals over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordina.session import written

HASH_DIGITS = 3


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
    weight: Column,
    out: str,
) -> DataFrame:
    """Running sum of `weight` per `keys`, in the order of `(bucket, order)`.

    A window over `keys` alone would sort a whole group in one task. Here the
    sort happens inside each `(keys, bucket)` cell, so the work of a large group
    spreads over its buckets; what lies before a bucket is a window over bucket
    totals only, or without keys `prefix_starts`. The caller picks `bucket` so that
    it does not fall when the order rises and has a bounded number of values per
    group. Keys must not be null.
    """
    cell = [*keys, *bucket]
    totals = df.groupBy(*cell).agg(F.sum(weight).alias("__cell"))
    if keys:
        before = Window.partitionBy(*keys).orderBy(*bucket)
        before = before.rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("__cell").over(before), F.lit(0))
        starts = totals.select(*cell, start.alias("__start"))
    else:
        starts = prefix_starts(totals, bucket, "__cell").drop("__cell")
    inside = (
        Window.partitionBy(*cell)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        df.withColumn("__inside", F.sum(weight).over(inside))
        .join(starts, cell)
        .withColumn(out, F.col("__start") + F.col("__inside"))
        .drop("__inside", "__start")
    )


def prefix_starts(totals: DataFrame, order: Sequence[str], weight: str) -> DataFrame:
    """`totals` with `__start`, the sum of `weight` over all rows that come before in `order`.

    Rows are dealt by range and summed up inside their partition; the driver sees one
    total per partition and no task sees all rows. `order` must not tie.
    """
    parts = totals.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = written(parts, "ranges")
    start, offsets = 0, [F.lit(-1), F.lit(0).cast("bigint")]
    for row in sorted(parts.groupBy("__part").agg(F.sum(weight).alias("n")).collect()):
        offsets += [F.lit(row["__part"]), F.lit(start).cast("bigint")]
        start += row["n"]
    before = Window.partitionBy("__part").orderBy(*order)
    inside = F.sum(weight).over(before.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.element_at(F.create_map(*offsets), F.col("__part"))
    return parts.withColumn("__start", ahead + F.coalesce(inside, F.lit(0))).drop("__part")


def hash_key(seed: int | str, *columns: Column | str) -> Column:
    """Seeded, engine-independent order key; a null counts as an empty text."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat(F.lit(str(seed)), *texts))


def shuffled_rank(
    df: DataFrame, keys: Sequence[str], id_col: str, seed: int | str, out: str
) -> DataFrame:
    """1-based rank of each row in a seeded random order inside its group."""
    df = df.withColumn("__key", hash_key(seed, id_col)).withColumn(
        "__bucket", F.substring("__key", 1, HASH_DIGITS)
    )
    ranked = running_total(df, keys, ["__bucket"], ["__key", id_col], F.lit(1), out)
    return ranked.drop("__key", "__bucket")
