"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens: its documents one after another. A round fills one
window of 4096 tokens; each queue gets its share of the window and carries the part of
a token it is owed, its deficit, into the next round; an empty queue's share goes to the
others. With the deficits carried exactly, what a queue has given after any number of
rounds no longer depends on the path there: token j of a queue with weight q falls due
at time (j + 1/2) / q, and window w holds the tokens of rank 4096 w to 4096 (w + 1) - 1
by due time. Ranks need only the number of tokens and the weight of each queue, so that
every task finds its own windows, and no state passes through one task. The mixture of
every window is within one token a source of the target while no queue has run out.

The last window is cut into sequences whose lengths are powers of two and that
need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordina.llm.common import tidy
from ordina.llm.tokens import encoder_of
from ordina.session import written

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"


# --- tokens ------------------------------------------------------------------


def _tokenised(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, given = encoder_of(path, END_ID), TaskContext.get().partitionId(), {}
        narrow = encoder.tokenizer.get_vocab_size() <= 1 << 16
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # About 4 MB of text at a time.
                size, to = 0, at
                while to < batch.num_rows and (to == at or size < 4 << 20):
                    size += len(batch.column("text")[to].as_py() or "")
                    to += 1
                rows = batch.slice(at, to - at)
                at = to
                ids = encoder.encode(rows.column("text").to_pylist())
                before = []
                for source, x in zip(rows.column("source").to_pylist(), ids):
                    before.append(given.get(source, 0))
                    given[source] = before[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        rows.column("source"),
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(before, pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([(x.astype("<u2") if narrow else x.astype("<u4")).tobytes() for x in ids], pa.binary()),
                    ],
                    ["doc_id", "source", "part", "before", "tokens", "ids"],
                )

    return run


# --- windows -----------------------------------------------------------------


class Rounds:
    """Which tokens of which queue each window takes."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray, window: int = WINDOW):
        self.totals, self.weights = totals.astype(np.int64), weights.astype(np.float64)
        self.window, self.all = window, int(totals.sum())

    def due(self, time: np.ndarray) -> np.ndarray:
        """Tokens of each queue that are due at each time: (times, queues)."""
        n = np.floor(time[:, None] * self.weights + 0.5)
        return np.minimum(n, self.totals).astype(np.int64)

    def taken(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue in the windows before each window: (windows, queues)."""
        rank = np.minimum(windows * self.window, self.all)
        lo = np.full(len(rank), -1.0)
        hi = np.full(len(rank), float((self.totals / self.weights).max()) + 1)
        while True:
            mid = (lo + hi) / 2
            if ((mid <= lo) | (mid >= hi)).all():
                break
            low = self.due(mid).sum(axis=1) <= rank
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        n, after = self.due(lo), self.due(hi)
        # Tokens due at one time come in the order of their queues.
        room = rank - n.sum(axis=1)
        tied = after - n
        first = np.clip(room[:, None] - (np.cumsum(tied, axis=1) - tied), 0, tied)
        return n + first

    def around(self, queue: int, first: int, last: int) -> tuple[int, int]:
        """Windows that surely hold the tokens first to last of a queue."""
        time = (np.array([first, last]) + 0.5) / self.weights[queue]
        rank = self.due(time).sum(axis=1)
        slack = 1 + len(self.totals) // self.window + 1
        return max(0, int(rank[0] // self.window) - slack), int(rank[1] // self.window) + slack

    def tail(self) -> np.ndarray:
        """Offsets in the last, short window at which a new sequence begins."""
        rest = self.all % self.window
        bits = [1 << b for b in range(self.window.bit_length()) if rest >> b & 1][::-1]
        return np.cumsum([0, *bits])[:-1]


def pieces(rounds: Rounds, queue: np.ndarray, first: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document's number, start, length, sequence, offset) of every piece.

    Document d holds the tokens first[d] to first[d] + tokens[d] - 1 of its queue.
    """
    found = []
    full = rounds.all // rounds.window
    cuts = rounds.tail()
    for q in np.unique(queue):
        docs = np.flatnonzero(queue == q)
        docs = docs[np.argsort(first[docs], kind="stable")]
        a, b = first[docs], first[docs] + tokens[docs]
        w0, w1 = rounds.around(int(q), int(a[0]), int(b[-1]) - 1)
        windows = np.arange(w0, w1 + 2)
        taken = rounds.taken(windows)
        begin, end = taken[:-1, q], taken[1:, q]
        given = np.diff(taken, axis=0)
        ahead = np.cumsum(given, axis=1)[:, q] - given[:, q]
        lo = np.searchsorted(end, a, side="right")
        hi = np.searchsorted(begin, b, side="left")
        n = hi - lo
        doc = np.repeat(np.arange(len(docs)), n)
        w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[doc]
        x, y = np.maximum(a[doc], begin[w]), np.minimum(b[doc], end[w])
        keep = y > x
        doc, w, x, y = doc[keep], w[keep], x[keep], y[keep]
        offset = ahead[w] + x - begin[w]
        sequence = w + w0
        found.append((docs[doc], x - a[doc], y - x, sequence, offset))
    number, start, length, sequence, offset = (np.concatenate(x) for x in zip(*found))
    short = sequence >= full
    if short.any():
        # The last window's sequences are numbered on from `full`.
        out = [np.stack((number, start, length, sequence, offset))[:, ~short]]
        ends = np.append(cuts[1:], rounds.all % rounds.window)
        for k, (c, e) in enumerate(zip(cuts, ends)):
            x = np.maximum(offset[short], c)
            y = np.minimum(offset[short] + length[short], e)
            on = y > x
            out.append(
                np.stack((number[short], start[short] + x - offset[short], y - x, np.full(len(x), full + k), x - c))[:, on]
            )
        number, start, length, sequence, offset = np.concatenate(out, axis=1)
    return number, start, length, sequence, offset


def _packed(rounds: Rounds, numbers: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = batch.column("tokens").to_numpy()
            queue = np.array([numbers[s] for s in batch.column("source").to_pylist()])
            first = batch.column("base").to_numpy() + batch.column("before").to_numpy()
            number, start, length, sequence, offset = pieces(rounds, queue, first, tokens)
            blobs = batch.column("ids")
            crc = np.empty(len(number), np.int64)
            order = np.argsort(number, kind="stable")
            at, ids = -1, None
            for i in order:
                if number[i] != at:
                    at = number[i]
                    raw = blobs[int(at)].as_py()
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * tokens[at] else "<u4").astype("<u4")
                crc[i] = zlib.crc32(ids[start[i] : start[i] + length[i]])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(number)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc),
                    pa.array(tokens[number]),
                    pa.array(sequence),
                    pa.array(offset),
                    batch.column("source").take(pa.array(number)),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, weights: dict[str | None, float] | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all `docs` (doc_id, text, source) in sequences of at most `window` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    source. Each document's ids end with END_ID; null and empty texts have only that.
    A null source is a queue of its own. `weights` gives the target proportions by
    source (missing ones count as 1); by default each source's share of all tokens,
    so that all queues run out together. Rows with equal or null ids are packed like
    any other; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = public_tokenizers.path(vocabulary)
    tokens = written(
        docs.select("doc_id", "text", F.col("source").cast("string").alias("source")).mapInArrow(
            tidy(_tokenised(path)), f"doc_id {kind}, source string, part int, before long, tokens long, ids binary"
        ),
        "tokens",
    )
    by_part = tokens.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    bases = written(bases.select(F.col("source").alias("queue"), F.col("part").alias("of_part"), "base", "n"), "bases")
    # One row per source.
    totals = bases.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()
    if not totals:
        out = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
        return spark.createDataFrame([], out.format(kind))
    count = np.array([r.n for r in totals])
    share = count if weights is None else np.array([weights.get(r.queue, 1.0) for r in totals])
    rounds = Rounds(count, share / share.sum(), window)
    placed = tokens.join(bases, (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("queue")))
    return placed.select("doc_id", "source", "base", "before", "tokens", "ids").mapInArrow(
        tidy(_packed(rounds, {r.queue: i for i, r in enumerate(totals)})),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string",
    )
