"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, the rest of the corpus is unlabelled. With the
class prior p, the risk on negatives is the risk of calling unlabelled texts toxic less
p times that of calling positives so; where a batch drives this difference below zero,
the step goes the other way, which keeps the estimate from overfitting below zero.

The classifier is a logistic model over hashed words and word beginnings: whether a text
has one, whether it has it again and again (twice, three times or more, for its length).
It is fitted in numpy on a bounded sample: about MAX_POSITIVE positives and MAX_UNLABELLED
other texts, picked by a hash of the id. All hashed features take part whose share differs
between both kinds by more than SURE standard errors. Every whole text is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.llm.common import WordTable, give_back, held_out, tidy, trainable
from ordina.session import written

CELLS = 1 << 20
BEGINNINGS = (4, 5, 6, 7)
MAX_POSITIVE = 4_000
MAX_UNLABELLED = 10_000
LEAST_TEXTS = 5  # of the sample, for a cell to be tested
SURE = 4.0  # standard errors
LEVELS = ((1, 0), (2, 250), (3, 120))  # at least so many, and one among so many words
CUT = 0.3


def _trim(word: str) -> str:
    """Without what is no letter or digit at either end."""
    while word and not word[0].isalnum():
        word = word[1:]
    while word and not word[-1].isalnum():
        word = word[:-1]
    return word


def word_cells(word: str) -> tuple[int, ...]:
    """Cells of a word and of its beginnings."""
    word = _trim(word)
    if not word:
        return ()
    parts = [word + "\n"] + [word[:n] for n in BEGINNINGS if len(word) >= n]
    return tuple(xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) & (CELLS - 1) for p in parts)


def text_cells(text: str | None, table: WordTable) -> list[int]:
    """Cells of a text: those of its words, once for each level that their number reaches."""
    if not text:
        return []
    words = text.lower().split()
    counts: dict[int, int] = {}
    for word, n in Counter(words).items():
        for cell in table[word]:
            counts[cell] = counts.get(cell, 0) + n
    return [
        cell + level * CELLS
        for cell, n in counts.items()
        for level, (least, among) in enumerate(LEVELS)
        if n >= least and n * among >= (len(words) if among else 0)
    ]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = WordTable(word_cells)
    for batch in batches:
        rows = [np.fromiter(text_cells(t.as_py(), table), np.int32) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("positive"), batch.column("unlabelled"), pa.array(rows, pa.list_(pa.int32()))],
            ["positive", "unlabelled", "cells"],
        )


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.bases = {c % CELLS for c in weights}

    def word(self, word: str) -> tuple[int, ...]:
        return tuple(c for c in word_cells(word) if c in self.bases)

    def score(self, text: str | None, table: WordTable) -> float:
        z = self.bias + sum(self.weights.get(c, 0.0) for c in sorted(text_cells(text, table)))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class SparseRows:
    """Texts as the places of their cells among the chosen ones."""

    def __init__(self, rows: list[np.ndarray]):
        self.length = np.array([len(r) for r in rows], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)

    def batch(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the batch, place) of all cells of the texts `at`."""
        n = self.length[at]
        row = np.repeat(np.arange(len(at)), n)
        return row, self.flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)]


def fit(
    rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7
) -> Model:
    """Minimise the non-negative risk over texts given as distinct cells; Adam on batches of both kinds.

    Cells that `chosen_cells` would not choose among these texts have no part in it.
    """
    if not positive.any() or not unlabelled.any():
        return Model({}, -40.0)
    cells = _sure_cells(rows, positive, unlabelled)
    x = SparseRows([np.searchsorted(cells, np.intersect1d(r, cells)) for r in rows])
    x_p, x_u = np.flatnonzero(positive), np.flatnonzero(unlabelled)
    rng = np.random.default_rng(seed)
    w = np.zeros(len(cells) + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    steps = 800

    def scores(at: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """Scores of a batch, and the gradient for given slopes of its rows."""
        row, place = x.batch(at)
        z = np.bincount(row, w[place], len(at)) + w[-1]

        def gradient(slope: np.ndarray) -> np.ndarray:
            return np.append(np.bincount(place, slope[row], len(cells)), slope.sum()) / len(at)

        return z, gradient

    for step in range(1, steps + 1):
        z_p, of_p = scores(x_p[rng.integers(0, len(x_p), 512)])
        z_u, of_u = scores(x_u[rng.integers(0, len(x_u), 1536)])
        s_p, s_u = sigmoid(z_p), sigmoid(z_u)
        # Logistic loss: l(z, +) = log(1 + e^-z), l(z, -) = log(1 + e^z).
        as_negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        negative = of_u(s_u) - prior * of_p(s_p)
        grad = prior * of_p(s_p - 1) + negative if as_negative >= 0 else -negative
        penalty = 2e-4 * w
        penalty[-1] = 0
        grad = grad + penalty
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        rate = 0.05 * (1 - step / (steps + 1)) + 0.002
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({int(c): float(k) for c, k in zip(cells, w) if k}, float(w[-1]))


def _sure_cells(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """`chosen_cells` of texts that are here already."""
    n_p, n_u = max(1, positive.sum()), max(1, unlabelled.sum())
    cells, at = np.unique(np.concatenate([*rows, np.empty(0, np.int32)]), return_inverse=True)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    p, u = (np.bincount(at, kind[of], len(cells)) for kind in (positive, unlabelled))
    share = (p + u) / (n_p + n_u)
    error = np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    return cells[(p + u >= LEAST_TEXTS) & (np.abs(p / n_p - u / n_u) / error > SURE)]


def chosen_cells(sample: DataFrame) -> DataFrame:
    """(cell) whose share among positives differs surely from that among unlabelled texts.

    All cells that stand in `LEAST_TEXTS` texts of the sample are tested, and all whose
    difference is more than `SURE` standard errors are kept.
    """
    totals = sample.agg(*[F.sum(F.col(c).cast("long")).alias(f"n_{c[0]}") for c in ("positive", "unlabelled")]).first()
    n_p, n_u = (max(1, totals[f"n_{c}"] or 0) for c in "pu")
    seen = sample.select("positive", "unlabelled", F.explode("cells").alias("cell")).groupBy("cell")
    seen = seen.agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum(F.col("unlabelled").cast("long")).alias("u"))
    p, u = F.col("p"), F.col("u")
    share = (p + u) / F.lit(n_p + n_u)
    error = F.sqrt(share * (1 - share) * F.lit(1 / n_p + 1 / n_u) + F.lit(1e-12))
    gap = F.abs(p / F.lit(n_p) - u / F.lit(n_u)) / error
    return seen.where((p + u >= LEAST_TEXTS) & (gap > SURE)).select("cell")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on rows that may be learned from. `labels` (doc_id, toxic) may repeat ids: the largest label counts.

    The sample's cells are counted and chosen by Spark; the driver gets the chosen cells
    of each text of the sample, not its words.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & trainable(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg((F.max("toxic") == 1).alias("toxic"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic")).first()
    if not counts.n or not counts.toxic:
        return Model({}, -40.0)
    prior = float(np.clip(counts.toxic / counts.n, 1e-4, 0.5))
    learn = docs.where(trainable(F.col("doc_id")))
    n_docs = max(1, learn.count())
    parts = 1 << 40

    def rate(bound: int, n: int) -> int:
        return int(min(1.0, bound / n) * parts)

    place = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(parts))
    # Picked by hash alone: about MAX_POSITIVE ids of 8 bytes.
    some = known.where("toxic").where(place < rate(MAX_POSITIVE, counts.toxic)).select("id", F.lit(True).alias("positive"))
    other = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.lit(parts)) < rate(MAX_UNLABELLED, n_docs)
    rows = learn.select("doc_id", "text", other.alias("unlabelled")).join(F.broadcast(some), F.col("doc_id") == F.col("id"), "left")
    rows = rows.withColumn("positive", F.coalesce("positive", F.lit(False))).where("positive OR unlabelled")
    found = rows.select("positive", "unlabelled", "text").mapInArrow(
        tidy(_featured), "positive boolean, unlabelled boolean, cells array<int>"
    )
    sample = written(found, "toxicity-sample")
    cells = np.sort(np.array([r.cell for r in chosen_cells(sample).collect()], np.int32))
    kept = sample.mapInArrow(tidy(_kept(cells)), "positive boolean, unlabelled boolean, cells binary").collect()
    # The order of rows must not matter.
    kept.sort(key=lambda r: (len(r.cells), r.positive, r.unlabelled, bytes(r.cells)))
    model = fit(
        [np.frombuffer(r.cells, "<i4") for r in kept],
        np.array([r.positive for r in kept], bool),
        np.array([r.unlabelled for r in kept], bool),
        prior,
    )
    del kept
    give_back()
    return model


def _kept(cells: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.intersect1d(r.values.to_numpy(), cells).astype("<i4").tobytes() for r in batch.column("cells")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), batch.column("unlabelled"), pa.array(rows, pa.binary())],
                ["positive", "unlabelled", "cells"],
            )

    return run


def _scored(shared, keep_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = WordTable(model.word)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            scores = [model.score(t.as_py(), table) for t in text]
            if keep_text:
                yield batch.filter(pa.array([s < CUT for s in scores], pa.bool_()))
            else:
                kept = [c for c in batch.schema.names if c != "text"]
                predicted = [int(s >= CUT) for s in scores]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())],
                    [*kept, "score", "predicted"],
                )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text).

    Null and empty texts have no feature and get the bias as score. Without a
    learnable positive every score is almost 0. A null id is not learned from and not
    held out; null labels are ignored. Rows with equal ids stay rows; other columns
    are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(tidy(_scored(shared, False)), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(tidy(_scored(shared, True)), docs.schema)
