"""Readers and writers for the study tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordina.config import series_schema, subject_schema
from ordina.session import written
from ordina.sources.versions import path_exists, publish, table_path

# Rows of the ids that have no folder of their own; readers of the folders skip the name.
SHARED = "_shared"


def scan_subjects(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Subject CSV with a header, typed by column name.

    The file may order its columns as it likes; columns the schema does not know
    are text. Only the header is read for this, no inference pass runs. A value
    that does not fit its type fails the query.
    """
    known = {f.name: f for f in (schema or subject_schema()).fields}
    header = spark.read.option("header", True).csv(path).columns
    fields = [known.get(c, T.StructField(c, T.StringType())) for c in header]
    reader = spark.read.schema(T.StructType(fields)).option("header", True)
    return reader.option("mode", "FAILFAST").csv(path)


def scan_series(
    spark: SparkSession,
    root: str,
    schema: T.StructType | None = None,
    id_col: str = "id",
) -> DataFrame:
    """All `id=<value>` folders below `root`, and the rows of ids without one, as one table.

    Naming the id column in the schema as a string keeps ids such as `0012` or
    `1e5` as they are written in the folder names.
    """
    schema = schema or series_schema()
    if not isinstance(schema[id_col].dataType, T.StringType):
        raise ValueError(f"{id_col} must be a string in the series schema")
    reader = spark.read.schema(schema)
    folders, shared = reader.parquet(root), f"{root}/{SHARED}"
    return folders.unionByName(reader.parquet(shared)) if path_exists(spark, shared) else folders


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """A gold, unlabelled or test feature table; of a published one, its current version."""
    return spark.read.parquet(table_path(spark, path))


scan_gold = scan_unlabelled = scan_test = scan_table


def lookup_mapper(spark: SparkSession, path: str, part: str = "main") -> dict[str, dict[str, int]]:
    """Label-to-code maps `{part: {column: {label: code}}}` from one small JSON file."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return {c: dict(m) for c, m in json.loads(text)[part].items()}


def sink_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def sink_gold(df: DataFrame, target: str, gold_path: str, unlabelled_path: str) -> None:
    """Labelled rows to one table, rows without target (and without folds) to another.

    The labelled table gets one folder per `fold_info`, so reading the rows of
    one fold skips the files of the others.
    """
    for part, path, folders in zip(_by_target(df, target), (gold_path, unlabelled_path), (_folders(df), ())):
        sink_table(part, path, folders)


def _by_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with and without target, of a copy, so that what makes them runs once."""
    df = written(df, "by-target")
    return df.where(F.col(target).isNotNull()), df.where(F.col(target).isNull()).drop("fold_info")


def _folders(df: DataFrame) -> list[str]:
    return ["fold_info"] if "fold_info" in df.columns else []


def publish_gold(df: DataFrame, target: str, gold_path: str, unlabelled_path: str) -> None:
    """The tables of `sink_gold`, replaced in one commit and read with `scan_table`.

    A job that is killed at any point leaves the old pair readable or the new one.
    """
    publish_pair(*_by_target(df, target), gold_path, unlabelled_path, _folders(df))


def publish_pair(
    gold: DataFrame, rest: DataFrame, gold_path: str, unlabelled_path: str, folders: Sequence[str] = ("fold_info",)
) -> None:
    publish({"gold": (gold, folders), "unlabelled": (rest, ())}, gold_path, {unlabelled_path: "unlabelled"})


sink_test = sink_table


def sink_pseudo(df: DataFrame, path: str) -> None:
    """A pseudo-labelled training set or its scores, with one folder per `fold_info`."""
    sink_table(df, path, ["fold_info"])


def sink_submission(
    preds: DataFrame, path: str, id_col: str, value_col: str, target: str
) -> None:
    """`(id, target)` rows: the class or, for a raw submission, the score."""
    sink_table(preds.select(id_col, F.col(value_col).alias(target)), path)


def sink_results(tables: Mapping[str, DataFrame], root: str) -> None:
    """One parquet table per result name below `root`."""
    for name, df in tables.items():
        sink_table(df, f"{root}/{name}")


def publish_results(tables: Mapping[str, DataFrame], root: str) -> None:
    """The result tables below `root`, all replaced in one commit."""
    publish({name: (df, ()) for name, df in tables.items()}, root)


def write_series(
    df: DataFrame, root: str, id_col: str = "id", rows_per_file: int = 5_000_000, max_folders: int = 1_000
) -> None:
    """Write a series in the folder-per-id layout `scan_series` reads.

    The `max_folders` ids with the most rows get a folder, so that files do not multiply
    with the ids; rows of all other ids share files, which need no shuffle. An id gets one
    file for each `rows_per_file` rows of its folder, written by as many tasks.
    """
    counts = df.groupBy(F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    # A folder's name cannot tell an empty id from a missing one.
    named = counts.where(F.length(F.col("__id").cast("string")) > 0)
    files = F.ceil(F.col("__n") / F.lit(rows_per_file)).cast("int").alias("__files")
    largest = named.orderBy(F.desc("__n"), "__id").limit(max_folders).select("__id", files)
    largest = F.broadcast(written(largest, "largest"))
    mine, columns = F.col(id_col) == F.col("__id"), [f"`{c}`" for c in df.columns]
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != id_col]), F.col("__files"))
    rows = df.join(largest, mine).withColumn("__salt", spread)
    rows.repartition(id_col, "__salt").select(*columns).write.partitionBy(id_col).parquet(root)
    df.join(largest, mine, "left_anti").select(*columns).write.parquet(f"{root}/{SHARED}")
