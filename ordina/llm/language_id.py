"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per (language, cell) come from all documents that may be learned from: each
task adds up its own matrix and sends the cells that are not zero. The matrix of log
probabilities has languages x CELLS numbers whatever the size of the corpus; it is
broadcast, and a batch of texts is scored by summing its rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.llm.common import held_out, tidy, trainable

CELLS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
MIN_SCORE = 0.5
STEP = 1 << 18

_NO_LETTERS = re.compile(r"[\W\d_]+")
_SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def letters(text: str | None) -> str:
    """Lower-cased runs of letters between single spaces; empty without a letter."""
    if not text:
        return ""
    plain = _NO_LETTERS.sub(" ", text.lower()).strip()
    return f" {plain} " if any(map(str.isalpha, plain)) else ""


def cells(plain: str) -> Iterator[np.ndarray]:
    """Cells of all character n-grams, in stretches of bounded length."""
    points = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), STEP):
        part = points[at : at + STEP + max(ORDERS) - 1]
        mixed = np.zeros(len(part), np.uint32)
        found = []
        for n in range(1, max(ORDERS) + 1):
            last = min(STEP, len(part) - n + 1)
            if last <= 0:
                break
            mixed = mixed[:last] * np.uint32(0x01000193) + part[n - 1 : n - 1 + last] * _SPREAD[n % 3] + np.uint32(n)
            if n in ORDERS:
                h = mixed ^ (mixed >> np.uint32(15))
                h = h * np.uint32(0x2C1B3C6D)
                found.append((h ^ (h >> np.uint32(13))) & np.uint32(CELLS - 1))
        yield np.concatenate(found)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            plain = letters(text.as_py())
            if plain:
                mine = counts.setdefault(lang, np.zeros(CELLS, np.int64))
                texts[lang] = texts.get(lang, 0) + 1
                for c in cells(plain):
                    mine += np.bincount(c, minlength=CELLS)
    for lang, mine in counts.items():
        used = np.flatnonzero(mine)
        # Cell -1 holds the number of texts.
        cell, n = np.append(used, -1), np.append(mine[used], texts[lang])
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(cell)), pa.array(cell.astype(np.int32)), pa.array(n)], ["lang", "cell", "n"]
        )


class Model:
    """Sorted languages and log probabilities (CELLS, languages)."""

    def __init__(self, names: list[str], counts: np.ndarray, texts: np.ndarray):
        self.names = names
        smooth = counts.astype(float) + SMOOTHING
        self.log = np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T)
        self.prior = np.log(texts / texts.sum()) if len(names) else np.zeros(0)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its probability."""
        total = np.tile(self.prior, (len(texts), 1))
        known = np.zeros(len(texts), bool)
        held, starts, owners, size = [], [], [], 0

        def add() -> None:
            if held:
                sums = np.add.reduceat(self.log[np.concatenate(held)], starts, axis=0)
                np.add.at(total, owners, sums)

        for i, text in enumerate(texts):
            plain = letters(text) if self.names else ""
            known[i] = bool(plain)
            for c in cells(plain) if plain else ():
                held.append(c), starts.append(size), owners.append(i)
                size += len(c)
                if size > 4 * STEP:
                    add()
                    held, starts, owners, size = [], [], [], 0
        add()
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        share = odds.max(axis=1) / odds.sum(axis=1)
        best = odds.argmax(axis=1)
        return (
            [self.names[k] if ok else UNKNOWN for k, ok in zip(best, known)],
            [float(s) if ok else 0.0 for s, ok in zip(share, known)],
        )


def train(docs: DataFrame) -> Model:
    """Fit on all rows of `docs` (doc_id, text, lang) that may be learned from."""
    rows = docs.where(F.col("lang").isNotNull() & trainable(F.col("doc_id"))).select("text", F.col("lang").cast("string").alias("lang"))
    found = rows.mapInArrow(tidy(_counted), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    counts, texts = np.zeros((len(names), CELLS), np.int64), np.zeros(len(names))
    row = np.searchsorted(names, found["lang"].to_numpy(str)) if names else np.zeros(0, int)
    cell, n = found["cell"].to_numpy(int), found["n"].to_numpy(int)
    on = cell >= 0
    counts[row[on], cell[on]] = n[on]
    texts[row[~on]] = n[~on]
    return Model(names, counts, texts)


def _predicted(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for at in range(0, batch.num_rows, 500):
                some = model.score(batch.column("text").slice(at, 500).to_pylist())
                names += some[0]
                scores += some[1]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs` (doc_id, text, lang).

    Null texts and texts without a letter get `und` and score 0, as does everything
    if nothing could be learned. Ties go to the first language by name. A null id is
    not learned from and not held out; a null lang is not learned from. Rows with
    equal ids stay rows; other columns are ignored; an empty table gives no rows.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(tidy(_predicted(shared)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _judged(shared, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            column = batch.column(batch.schema.get_field_index("text"))
            for at in range(0, batch.num_rows, 500):
                some = shared.value.score(column.slice(at, 500).to_pylist())
                names += some[0]
                scores += some[1]
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The rows of `docs` whose language is found with a score of at least `least`, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.mapInArrow(tidy(_judged(shared, least)), docs.schema)
