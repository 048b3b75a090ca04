"""Benchmark decontamination by template windows.

A text becomes a template: numbers, names and units give way to placeholders, the
other words stay, lower-cased and without punctuation. Windows of 8 template words of
documents and benchmark items are hash-joined. The values that fill the placeholders
are carried along; where an item and a document agree on windows at one distance, each
value of the item must stand for one value in the document throughout. So a question
is found verbatim as well as with other numbers and names in it.

Documents' windows are sifted before the join by a bitmap of the items' windows, whose
size is fixed (FILTER_BITS); what it lets through by chance falls out in the join.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.llm.common import free_name, mix64, signed, slices, tidy, utf8, WordTable
from ordina.session import written

WINDOW = 8
LEAST_LITERAL = 4
SHORTEST = 4
FILTER_BITS = 1 << 23

# Unit words that may follow a number.
UNITS = frozenset(
    b"% mm cm m km kilometers kilometres meters metres miles mile feet foot ft inches inch in yards mg g kg grams"
    b" kilograms pounds lbs lb ounces oz tons ml l liters litres gallons s sec seconds min minutes h hours hour days day"
    b" weeks week months month years year mph kmh dollars dollar cents euros euro percent degrees watts volts hz".split()
)
_NUMBER = re.compile(rb"[$\xe2\x82\xac\xc2\xa3+\-(\[]*\d[\d.,:/]*(%|[A-Za-z]{0,3})[^\w]*")
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NUM, _CAP, _END, _UNIT, _DROP = 1, 2, 4, 8, 16
_FLAGS = 31
# What stands for a number, a name and a unit.
_PLACE = np.array([0x1F83D9ABFB41BD40, 0x5BE0CD19137E2160, 0x3C6EF372FE94F820], np.uint64)
_MULTIPLIER = 0x9FB21C651E98DF25
_U = np.uint64


def word_code(word: bytes) -> int:
    """Hash of the bare word in the upper bits, what kind it is in the lower five."""
    core = word.strip(_EDGE)
    flags = _END if word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":") else 0
    if _NUMBER.fullmatch(word):
        flags |= _NUM
    elif not core:
        flags |= _UNIT if word == b"%" else _DROP
    else:
        if core.lower() in UNITS:
            flags |= _UNIT
        plain = core.decode("utf-8", "replace")
        if len(plain) > 1 and plain[0].isupper() and plain[1:].islower():
            flags |= _CAP
        core = plain.lower().encode("utf-8", "replace")
    return xxhash.xxh3_64_intdigest(core) & ~_FLAGS | flags


class Template:
    """Template words of one text: codes, which are literal, and where their words begin."""

    def __init__(self, text: bytes | None, table: WordTable):
        self.words = text.split() if text else []
        v = np.fromiter(map(table.__getitem__, self.words), np.uint64, len(self.words))
        flags = (v & _U(_FLAGS)).astype(np.uint8)
        after_end = np.concatenate(([True], flags[:-1] & _END > 0))[: len(v)]
        at = np.flatnonzero(flags & _DROP == 0)
        v, flags, after_end = v[at], flags[at], after_end[at]
        number = flags & _NUM > 0
        unit = (flags & _UNIT > 0) & np.concatenate(([False], number[:-1]))[: len(v)]
        name = (flags & _CAP > 0) & ~after_end & ~unit
        code = np.where(number, _PLACE[0], np.where(name, _PLACE[1], np.where(unit, _PLACE[2], v & ~_U(_FLAGS))))
        # A name of several words is one.
        keep = ~(name & np.concatenate(([False], name[:-1]))[: len(v)])
        self.code, self.at = code[keep], at[keep]
        self.literal = ~(number | name | unit)[keep]

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of the windows with enough literal words."""
        last = len(self.code) - length + 1
        if last <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        mixed = np.zeros(last, np.uint64)
        for i in range(length):
            mixed = mixed * _U(_MULTIPLIER) + (self.code[i : i + last] ^ (self.code[i : i + last] >> _U(29)))
        run = np.concatenate(([0], np.cumsum(self.literal)))
        good = np.flatnonzero(run[length:] - run[:-length] >= min(LEAST_LITERAL, length - 1))
        return good, mix64(mixed[good] + _U(length))

    def slots(self, position: int, length: int) -> list[str]:
        """The words behind the placeholders of a window, bare and lower-cased."""
        found = []
        for i in range(position, position + length):
            if not self.literal[i]:
                to = self.at[i + 1] if i + 1 < len(self.at) else len(self.words)
                value = self.words[self.at[i] : to] if self.code[i] == _PLACE[1] else [self.words[self.at[i]]]
                found.append(" ".join(w.strip(_EDGE).decode("utf-8", "replace").lower() for w in value).strip())
        return found


_ITEM = "item long, length int, position long, hash long, slots array<string>"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = WordTable(word_code)
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item").to_pylist(), utf8(batch.column("text"))):
            t = Template(text, table)
            length = min(WINDOW, len(t.code))
            if length >= SHORTEST:
                for p, h in zip(*t.windows(length)):
                    rows.append((item, length, int(p), int(h.view(np.int64)), t.slots(p, length)))
        names = ("item", "length", "position", "hash", "slots")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))


def _document_windows(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, lengths = shared.value
        table = WordTable(word_code)
        for batch in slices(batches):
            row, position, hashes, slots = [], [], [], []
            for i, text in enumerate(utf8(batch.column("text"))):
                t = Template(text, table)
                for length in lengths:
                    p, h = t.windows(length)
                    cell = h & _U(FILTER_BITS - 1)
                    on = np.flatnonzero(bitmap[(cell >> _U(3)).astype(np.int64)] >> (cell & _U(7)).astype(np.uint8) & 1)
                    for k in on:
                        row.append(i), position.append(int(p[k])), hashes.append(int(h[k].view(np.int64)))
                        slots.append(t.slots(p[k], length))
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(taken),
                    batch.column("text_hash").take(taken),
                    pa.array(position, pa.int64()),
                    pa.array(hashes, pa.int64()),
                    pa.array(slots, pa.list_(pa.string())),
                ],
                ["doc_id", "text_hash", "at", "hash", "values"],
            )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_items, item_id, n_windows, rewritten) of the contaminated rows of `docs`.

    One row for each id and text: how many items it holds, the smallest of them, the
    most windows shared with one item, and whether a placeholder's value differs.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), "text").where("item IS NOT NULL")
    items = items.mapInArrow(_item_windows, _ITEM)
    # Of items with one window and the same values, the smallest stands for all.
    items = written(items.groupBy("hash", "slots", "position").agg(F.min("item").alias("item"), F.min("length").alias("length")), "items")
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    # At most FILTER_BITS cells.
    cells = items.select(F.pmod("hash", F.lit(FILTER_BITS)).cast("int").alias("cell")).distinct().toPandas()["cell"].to_numpy()
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    np.bitwise_or.at(bitmap, cells >> 3, (1 << (cells & 7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast((bitmap, lengths))

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = rows.mapInArrow(
        tidy(_document_windows(shared)), f"doc_id {kind}, text_hash long, at long, hash long, values array<string>"
    )
    rows = written(rows, "windows")
    hits = rows.join(items.select("hash", "item", "position", "slots"), "hash").withColumn("gap", F.col("at") - F.col("position"))
    place = ["doc_id", "text_hash", "item", "gap"]
    pairs = hits.select(*place, "at", F.posexplode_outer(F.arrays_zip("slots", "values")).alias("k", "pair"))
    by_value = pairs.groupBy(*place, F.col("pair.slots").alias("slot")).agg(
        F.min("pair.values").alias("lo"), F.max("pair.values").alias("hi")
    )
    by_value = by_value.groupBy(*place).agg(
        F.max(F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))).alias("torn"),
        F.max(F.coalesce(F.col("lo") != F.col("slot"), F.lit(False))).alias("rewritten"),
    )
    counted = hits.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({c: f"_{c}" for c in place})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    found = by_value.where("NOT torn").join(counted, same)
    by_item = found.groupBy("doc_id", "text_hash", "item").agg(F.sum("n").alias("n"), F.min("rewritten").alias("rewritten"))
    return by_item.groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.min("item").alias("item_id"),
        F.max("n").alias("n_windows"),
        F.max("rewritten").alias("rewritten"),
    )


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_id, n_windows, rewritten) for each row of `docs` (doc_id, text).

    Clean rows have no items, no windows and a null item_id. Null and empty texts are
    clean; items with less than 4 template words and null items are not looked for.
    Rows with equal ids are judged by their own texts; other columns are ignored; an
    empty table gives no rows.
    """
    found = leaks(docs, benchmark).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return rows.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "item_id",
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
        F.coalesce("rewritten", F.lit(False)).alias("rewritten"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without a benchmark item, all columns as they are."""
    of, text = free_name(docs, "_id"), free_name(docs, "_hash")
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias(of), F.col("text_hash").alias(text))
    on = F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(text))
    return docs.join(bad, on, "left_anti")
