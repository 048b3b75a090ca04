"""Periodic runs of words by an online diagonal DP over sparse links.

A run is a stretch of words in which words one period apart are identical. On the diagonal
of lag d the DP holds how many words before this one equal the word d places before them;
a word's earlier occurrences increment the match lengths of their lags, a diagonal that
gets no increment ends, and a match of m words on a diagonal of lag d is a stretch of
m + d words with period d, which is emitted at once if it is long enough.

Not every earlier occurrence is a link: their number grows with the square of a frequent
word. For lags from W / 2 + 1 to W, W a power of two, an occurrence counts where the W
words that end at it are the same, and only the nearest one. That loses no run: a run with
smallest period d holds more than d + W words, and inside it the nearest occurrence of W
words lies d places back, no less, since a primitive word does not equal its own rotation.
It adds none: had the stretch a smaller period, a nearer occurrence would be there. So the
links of one lag stand one after another just where W words of the diagonal match.

Texts that cannot hold a run are sifted out first: all windows of four words inside a run
occur elsewhere in it, so only stretches of such windows are looked at.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ordina.llm.common import mix64, tidy, utf8
from ordina.llm.merkle import CRC_SQL

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
WINDOW = 4  # words of a sifting window; no more than a run's words beyond its first period
BATCH_BYTES = 4 << 20
KNOWN_WORDS = 400_000
PRIME = np.uint64(0x9E3779B97F4A7C15)

Run = tuple[int, int, int]  # start, length, period


# --- sift --------------------------------------------------------------------


def _windows(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A hash of the words from each place on and of their document; none reaches over its end."""
    h = mix64(ids.astype(np.uint64) + np.uint64(1))
    h = mix64(h[:-1] * PRIME + h[1:])
    h = mix64(h[:-2] * PRIME + h[2:])
    return h ^ mix64(doc[: len(h)].astype(np.uint64) + PRIME)


def _nearest(codes: np.ndarray, places: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later): neighbouring places with equal upper bits of their codes."""
    low = np.uint64((1 << bits) - 1)
    keys = np.sort((codes & ~low) | places.astype(np.uint64))
    same = np.flatnonzero((keys[1:] ^ keys[:-1]) <= low)
    at = (keys & low).astype(np.int64)
    return at[same], at[same + 1]


def stretches(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges, each inside one document, that hold every run.

    Equal hashes of different windows only add ranges.
    """
    if len(ids) < LEAST_LENGTH:
        return []
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = len(ids) - WINDOW + 1
    places = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    codes = _windows(ids, doc)[places]
    earlier, later = _nearest(codes, places, max(1, len(ids).bit_length()))
    again = np.zeros(len(ids) + 2, bool)
    again[earlier + 1] = again[later + 1] = True
    edges = np.flatnonzero(again[1:] != again[:-1])
    if not len(edges):
        return []
    near = np.full(len(ids) + 1, len(ids))
    near[later] = later - earlier
    first, last = edges[::2], edges[1::2] + WINDOW - 1
    least = np.minimum.reduceat(near, edges)[::2]
    size = last - first
    on = (size >= LEAST_LENGTH) & (least * LEAST_EXPONENT <= size)
    return list(zip(first[on].tolist(), last[on].tolist()))


# --- links and diagonals -----------------------------------------------------


def links(ids: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, lag) of the links in `ids`, by word; lags above the word's `limit` left out.

    Windows of W words have numbers, equal ones the same; pairs of them number those of
    2 W words. A window that occurs once has none and takes no further part.
    """
    size, bits = len(ids), max(1, len(ids).bit_length())
    number = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    places, width, found = np.arange(size), 1, []
    while len(places) and width // 2 < limit.max():
        earlier, later = _nearest(number[places].astype(np.uint64) << np.uint64(bits), places, bits)
        lag, end = later - earlier, later + width - 1
        on = (lag > width // 2) & (lag <= np.minimum(limit[end], width))
        found.append((end[on], lag[on]))
        places = np.unique(np.concatenate((earlier, later)))
        alive = np.full(size, -1)
        alive[places] = number[places]
        places = places[places + width < size]
        places = places[alive[places + width] >= 0]
        pairs = alive[places] * size + alive[places + width]
        number = np.full(size, -1)
        number[places] = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word, lag = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(word, kind="stable")
    return word[order], lag[order]


def diagonals(word: np.ndarray, lag: np.ndarray) -> Iterator[Run]:
    """The runs that the links make, each when its diagonal ends."""

    def ended(at: int, matches: dict[int, int]) -> Iterator[Run]:
        for d, n in matches.items():
            length = n + (1 << (d - 1).bit_length()) - 1 + d
            if length >= max(LEAST_LENGTH, LEAST_EXPONENT * d):
                yield at + 1 - length, length, d

    cuts = np.flatnonzero(np.diff(word)) + 1
    active: dict[int, int] = {}
    before = -2
    for at, lags in zip(word[np.concatenate(([0], cuts))].tolist() if len(word) else [], np.split(lag, cuts)):
        if at != before + 1:
            yield from ended(before, active)
            active = {}
        grown = {d: active.pop(d, 0) + 1 for d in lags.tolist()}
        yield from ended(before, active)
        active, before = grown, at
    yield from ended(before, active)


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> list[list[Run]]:
    """The runs of each document, by start and period; document k holds the words bounds[k] to bounds[k + 1]."""
    out: list[list[Run]] = [[] for _ in bounds[1:]]
    kept = stretches(ids, bounds)
    if not kept:
        return out
    # One after another, with a word between them that occurs nowhere else.
    words, origin, limit = [], [], []
    for k, (a, b) in enumerate(kept):
        words += [ids[a:b], np.array([-1 - k])]
        origin.append(np.arange(a, b + 1))
        limit.append(np.full(b - a + 1, (b - a) // LEAST_EXPONENT))
    origin = np.concatenate(origin)
    for start, length, period in diagonals(*links(np.concatenate(words), np.concatenate(limit))):
        at = int(origin[start])
        k = int(np.searchsorted(bounds, at, side="right")) - 1
        out[k].append((at - int(bounds[k]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats: all of it but its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return list(compress(words, keep.tolist()))


# --- documents ---------------------------------------------------------------


def stuttered(words: list[bytes], doc_id: object) -> list[bytes]:
    """The words of every tenth document, by crc32 of its id, made periodic from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


Change = Callable[[list[bytes], object], list[bytes]]


def _each(batches: Iterator[pa.RecordBatch], change: Change | None) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[list[Run]]]]:
    """Batches of about 4 MB of text with the words and runs of their rows."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    for batch in batches:
        texts, ids = list(utf8(batch.column("text"))), batch.column("doc_id").to_pylist()
        at = 0
        while at < batch.num_rows:
            to, size, words = at, 0, []
            while to < batch.num_rows and size < BATCH_BYTES:
                size += len(texts[to] or b"")
                own = texts[to].split() if texts[to] else []
                words.append(change(own, ids[to]) if change else own)
                texts[to] = None
                to += 1
            if len(number) > KNOWN_WORDS:
                number.clear()
            bounds = np.cumsum([0, *map(len, words)])
            flat = np.empty(bounds[-1], np.int64)
            for k, own in enumerate(words):
                flat[bounds[k] : bounds[k + 1]] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
            yield batch.slice(at, to - at), words, runs_of(flat, bounds)
            at = to


def _mapped(docs: DataFrame, rows: Callable, schema: str, change: Change | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _each(batches, change):
            yield rows(*found)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(tidy(run), schema.format(kind))


def _longs(values: list) -> pa.Array:
    return pa.array(values, pa.int64())


def _run_rows(batch: pa.RecordBatch, words: list, runs: list[list[Run]]) -> pa.RecordBatch:
    row = [k for k, own in enumerate(runs) for _ in own]
    flat = [r for own in runs for r in own]
    columns = [batch.column("doc_id").take(_longs(row)), *(_longs([r[i] for r in flat]) for i in range(3))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "period"])


def _text_rows(batch: pa.RecordBatch, words: list, runs: list[list[Run]]) -> pa.RecordBatch:
    texts = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs)]
    columns = [batch.column("doc_id"), _longs([len(r) for r in runs]), pa.array(texts, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_runs", "text"])


def _digest_rows(batch: pa.RecordBatch, words: list, runs: list[list[Run]]) -> pa.RecordBatch:
    best = [min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if own else (None,) * 3 for own in runs]
    lists = ["".join(f"{s},{n},{p}\n" for s, n, p in own).encode() for own in runs]
    columns = [
        batch.column("doc_id"),
        _longs([len(own) for own in runs]),
        *(_longs([b[i] for b in best]) for i in range(3)),
        _longs([None if b[0] is None else 1000 * b[1] // b[2] for b in best]),
        pa.array([hashlib.sha256(x).hexdigest() for x in lists], pa.string()),
        pa.array([hashlib.sha256(b" ".join(collapsed(w, r))).hexdigest() for w, r in zip(words, runs)], pa.string()),
    ]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return pa.RecordBatch.from_arrays(columns, names)


def runs(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """(doc_id, start, length, period) of every run in every text of `docs` (doc_id, text).

    Words stand between ASCII spaces and are numbered from 0. Null and empty texts have no
    runs; rows with equal or null ids are texts of their own; other columns are ignored.
    `change` alters the words of a row, given its id.
    """
    return _mapped(docs, _run_rows, "doc_id {}, start long, length long, period long", change)


def collapse(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """(doc_id, n_runs, text): every text, its words joined by one space, each run cut to its first period.

    A null text becomes an empty one.
    """
    return _mapped(docs, _text_rows, "doc_id {}, n_runs long, text string", change)


def digest(docs: DataFrame, change: Change | None = stuttered) -> DataFrame:
    """One row per document: its number of runs, the one with the greatest exponent, and digests.

    (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).
    Of equal exponents the run with the smallest start, then period, is named; without runs
    the four are null. By default every tenth document stutters; null ids never do.
    """
    schema = "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _mapped(docs, _digest_rows, schema, change)


ORACLE = f"""
WITH RECURSIVE {CRC_SQL}, docs AS (
  SELECT row_number() OVER () AS r, d.doc_id, coalesce(crc % 10 = 0, false) AS hit, crc // 10 AS g,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents d LEFT JOIN crc ON d.doc_id IS NOT DISTINCT FROM crc.doc_id
), shape AS (
  SELECT *, len(words) AS n, g % greatest(len(words), 1) AS a,
         1 + (len(words) - g % greatest(len(words), 1)) // (3 + g % 8) AS p
  FROM docs
), w AS (
  SELECT r, n, i, words[1 + CASE WHEN hit AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM shape)
), matches AS (
  SELECT y.r, y.i, y.i - x.i AS d FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i
  WHERE {LEAST_EXPONENT} * (y.i - x.i) <= y.n
), islands AS (
  SELECT r, d, i, i - row_number() OVER (PARTITION BY r, d ORDER BY i) AS island FROM matches
), periodic AS (
  SELECT r, d, min(i) - d AS s, count(*) + d AS n FROM islands GROUP BY r, d, island
  HAVING count(*) + d >= greatest({LEAST_LENGTH}, {LEAST_EXPONENT} * d)
), runs AS (
  SELECT * FROM periodic x
  WHERE NOT EXISTS (SELECT 1 FROM periodic o WHERE o.r = x.r AND o.d < x.d AND o.s <= x.s AND o.s + o.n >= x.s + x.n)
), best AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || d || chr(10), '' ORDER BY s, d) AS listed,
         first(struct_pack(s := s, n := n, d := d) ORDER BY CAST(n AS DOUBLE) / d DESC, s, d) AS top
  FROM runs GROUP BY r
), gone AS (SELECT DISTINCT r, unnest(range(s + d, s + n)) AS i FROM runs),
kept AS (
  SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS text FROM w LEFT JOIN gone ON gone.r = w.r AND gone.i = w.i
  WHERE gone.r IS NULL GROUP BY w.r
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.s AS BIGINT) AS start, CAST(top.n AS BIGINT) AS length,
       CAST(top.d AS BIGINT) AS period, CAST(1000 * top.n // top.d AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
