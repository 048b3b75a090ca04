"""Best-fit packing by minimum bin slack.

Every document's ids are cut into pieces of at most 2048; packing needs only how many
pieces of each length there are, a table of at most 2048 rows. Bin after bin takes the
fullest feasible combination of the lengths left: the largest length, and beside it the
combination that a subset-sum DP over the available lengths finds; sums that can be
reached are the bits of one number. The combination is then removed. While the lengths
suffice the next bin would come out the same, so that it is removed as often as they
allow, and the work of planning does not depend on the number of pieces.

The plan deals the places of each length in the order of its bins. A piece is found there
by its rank among the pieces of its length: its rank in its task plus what earlier tasks
hold. So no bin, length or document meets in one task.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordina.llm.common import tidy
from ordina.llm.tokens import encoder_of
from ordina.session import written

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
BATCH_BYTES = 4 << 20

# --- plan --------------------------------------------------------------------


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length make the greatest sum up to `room`.

    Of equal sums the one with larger lengths is taken. Bit s of `sums` is set if some
    combination has sum s.
    """
    every = (1 << (room + 1)) - 1
    sums, tried = 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        tried.append((length, sums))
        copies, step = min(counts[length], room // length), 1
        while copies:
            step = min(step, copies)
            sums |= (sums << step * length) & every
            copies -= step
            step *= 2
        if sums >> room & 1:
            break
    left, taken = sums.bit_length() - 1, {}
    for length, before in reversed(tried):
        n = 0
        while not before >> left & 1:
            left -= length
            n += 1
        if n:
            taken[length] = n
    return taken


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(bins, lengths with their number in each) until nothing of `counts` is left."""
    counts = {n: k for n, k in counts.items() if k}
    out = []
    while counts:
        largest = max(counts)
        rest = {**counts, largest: counts[largest] - 1}
        taken = fullest(rest, capacity - largest)
        taken[largest] = taken.get(largest, 0) + 1
        bins = min(counts[n] // k for n, k in taken.items())
        out.append((bins, taken))
        for n, k in taken.items():
            counts[n] -= bins * k
            if not counts[n]:
                del counts[n]
    return out


@dataclass
class Places:
    """Where the pieces of one length go: for each combination with it, in their order.

    first: rank of the combination's first piece; each: pieces in a bin; bin: number of
    its first bin; offset: where they begin in a bin.
    """

    first: np.ndarray
    each: np.ndarray
    bin: np.ndarray
    offset: np.ndarray

    def of(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of the pieces with these ranks."""
        at = np.searchsorted(self.first, rank, side="right") - 1
        bins, copy = np.divmod(rank - self.first[at], self.each[at])
        return self.bin[at] + bins, self.offset[at] + copy * length


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, Places]:
    given: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    first_bin = 0
    for bins, taken in plan:
        offset = 0
        for length in sorted(taken, reverse=True):
            rows.setdefault(length, []).append((given.get(length, 0), taken[length], first_bin, offset))
            given[length] = given.get(length, 0) + bins * taken[length]
            offset += length * taken[length]
        first_bin += bins
    return {n: Places(*(np.array(x, np.int64) for x in zip(*r))) for n, r in rows.items()}


# --- pieces ------------------------------------------------------------------


def ranked(values: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Rank of each value among equal ones, on from `given`, which is brought up to date."""
    order = np.argsort(values, kind="stable")
    n = np.bincount(values, minlength=len(given))
    starts = np.cumsum(n) - n
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values)) - starts[values[order]]
    rank += given[values]
    given += n
    return rank


def _cut(path: str, end: int, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(path, end), TaskContext.get().partitionId()
        given = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            while at < batch.num_rows:
                to, size = at, 0
                while to < batch.num_rows and size < BATCH_BYTES:
                    size += len(texts[to] or "")
                    to += 1
                ids = [x.astype("<u4", copy=False) for x in encoder.encode(texts[at:to])]
                n = np.array([-(-len(x) // capacity) for x in ids])
                row = np.repeat(np.arange(len(ids)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(np.array([len(x) for x in ids])[row] - start, capacity)
                crc = [zlib.crc32(ids[r][s : s + m]) for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row + at)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array([part] * len(row), pa.int32()),
                        pa.array(ranked(length, given), pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"],
                )
                at = to

    return run


def _placed(found: dict[int, Places]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            bins, offset = np.empty_like(rank), np.empty_like(rank)
            for rows in np.split(order, cuts) if len(order) else []:
                bins[rows], offset[rows] = found[int(length[rows[0]])].of(int(length[rows[0]]), rank[rows])
            columns = [*(batch.column(c) for c in batch.schema.names if c != "rank"), pa.array(bins), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """Pieces of all `docs` (doc_id, text) in as few sequences of at most `capacity` tokens as found.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Each
    document's ids end with the id `end`, which is all that null and empty texts have.
    Rows with equal or null ids are documents of their own; other columns are ignored; an
    empty table gives no rows. `vocabulary` is the name of a public tokenizer's file.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = public_tokenizers.path(vocabulary)
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    pieces = written(rows.mapInArrow(tidy(_cut(path, end, capacity)), f"{schema}, part int, at long"), "pieces")
    cells = pieces.groupBy(F.col("length").alias("of_length"), F.col("part").alias("of_part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("of_length").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "cells")
    # At most `capacity` rows.
    counts = {r.of_length: r.n for r in cells.groupBy("of_length").agg(F.sum("n").alias("n")).collect()}
    plan = places(combinations(counts, capacity))
    placed = pieces.join(cells, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part")))
    placed = placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("rank"))
    return placed.mapInArrow(tidy(_placed(plan)), f"{schema}, sequence_id long, offset long")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
