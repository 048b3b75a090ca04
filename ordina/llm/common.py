"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
FOLDS = 4
HELD_OUT = 2


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """Whether nothing may be learned from the document; false for a null id."""
    return F.coalesce(fold_of(doc_id) == HELD_OUT, F.lit(False))


def trainable(doc_id: Column) -> Column:
    """Whether labels of the document may be learned; false for a null id."""
    return F.coalesce(fold_of(doc_id) != HELD_OUT, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


class WordTable(dict):
    """word (bytes) -> value of `make`; emptied when it holds `limit` words."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


def word_hashes() -> WordTable:
    return WordTable(xxhash.xxh3_64_intdigest)


def hashes_of(words: list[bytes], table: WordTable) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))


def lowered_words(text: bytes | None) -> list[bytes]:
    """Words between the ASCII spaces `\\x20\\x09-\\x0D`, with A-Z lower-cased."""
    return text.lower().split() if text else []


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string column as bytes, without decoding; null stays None."""
    column = column.cast(pa.large_binary())
    for value in column:
        yield value.as_py()


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark longs."""
    return values.astype(np.uint64, copy=False).view(np.int64)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The task function `run`, after which the process gives freed memory back.

    Python workers outlive their tasks; what one has freed would stay with it while
    other workers and the JVM need it.
    """

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; nothing to trim


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, so that results do not pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
