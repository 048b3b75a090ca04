"""Session helpers: the shared folder and tables written there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# The error of a job that needs kept rows which went with their executor.
LOST_ROWS = "CHECKPOINT_RDD_BLOCK_ID_NOT_FOUND"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    That is `spark.checkpoint.dir`; where it is unset, a folder in the warehouse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is ever written over."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write `df` to the shared folder and read it back, cutting its lineage.

    With `partition_by`, later filters on those columns read only their folders.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


@contextmanager
def kept_rows(df: DataFrame) -> Iterator[DataFrame]:
    """`df` with its rows kept by the executors, for several passes; freed at the end.

    Rows are kept as they are, so a pass does not decode columns as that of a cached table
    does. They are not made again: a job that needs those of a lost executor fails with
    `LOST_ROWS`.
    """
    kept = df.localCheckpoint(storageLevel=StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept._jdf.queryExecution().analyzed().rdd().unpersist(False)
