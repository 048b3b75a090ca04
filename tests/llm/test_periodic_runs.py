"""Runs against a search over all periods and places, and the collapsed texts."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ordina.llm import periodic_runs


def brute(words):
    """Every lag's maximal matches, without those that have a smaller period."""
    found = set()
    for d in range(1, len(words) // 4 + 1):
        i = d
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - d]:
                j += 1
            start, length = i - d, j - i + d
            if j > i and length >= max(6, 4 * d):
                smaller = (all(words[k] == words[k - q] for k in range(start + q, start + length)) for q in range(1, d))
                if not any(smaller):
                    found.add((start, length, d))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@st.composite
def documents(draw):
    out = []
    for _ in range(draw(st.integers(1, 4))):
        words = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 1, 2, 9]))), max_size=40))
        if words and draw(st.booleans()):
            a = draw(st.integers(0, len(words) - 1))
            p = draw(st.integers(1, 1 + (len(words) - a) // 3))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
            words += draw(st.lists(st.integers(0, 2), max_size=6))
        out.append(words)
    return out


@given(documents())
@settings(max_examples=400, deadline=None)
def test_runs_of_random_words(docs):
    bounds = np.cumsum([0, *map(len, docs)])
    flat = np.array([w for d in docs for w in d], np.int64)
    assert periodic_runs.runs_of(flat, bounds) == [brute(d) for d in docs]


def test_long_texts_stay_cheap():
    """One word, two words and a long period; all pairs of equal words would be 10 ** 10 to 10 ** 11."""
    n = 300_000
    assert periodic_runs.runs_of(np.zeros(n, np.int64), np.array([0, n])) == [[(0, n, 1)]]
    words = np.array(([1] * 1000 + [2]) * 300, np.int64)
    found = periodic_runs.runs_of(words, np.array([0, len(words)]))[0]
    assert (0, len(words), 1001) in found and len(found) == 301


TEXTS = [
    None, "", " \t\n ", "a a a a a", "a a a a a a", "A a a a a a", "x y\tx y\nx y\x0bx y", "x y x y x y x",
    "p q r " * 4 + "p", "b " * 7 + "c " * 9, "é é é é é é", "a a " * 5, "w " * 50_000, "no run at all here",
    "x a a a a a a b x a a a a a a b x a a a a a a b x a a a a a a b",
]


def frame(spark, texts):
    rows = [(None if i % 4 == 3 else i, t, i, "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, period string").repartition(3)


def split(text):
    return (text or "").encode().split()


def test_edge_cases(spark):
    want = []
    for i, t in enumerate(TEXTS):
        if len(t or "") < 1000:
            want += [(None if i % 4 == 3 else i, *r) for r in brute(split(t))]
        else:
            want.append((i if i % 4 < 3 else None, 0, 50_000, 1))
    got = periodic_runs.runs(frame(spark, TEXTS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    texts = {r.text for r in periodic_runs.collapse(frame(spark, TEXTS)).collect()}
    assert {"", "a a a a a", "a", "A a a a a a", "x y", "p q r", "b c", "é", "w", "no run at all here", "x a b"} <= texts
    empty = frame(spark, TEXTS).limit(0)
    assert periodic_runs.runs(empty).count() == periodic_runs.digest(empty).count() == 0


def test_digest_of_stuttering_documents(spark):
    """Rows whose id's crc32 ends in 0, of different lengths, against words altered one by one."""
    ids = [i for i in range(3_000) if zlib.crc32(str(i).encode()) % 10 == 0][:60] + [1, 2, None]
    rows = [(i, " ".join(f"w{(k * k) % 31}" for k in range(5 + 7 * n))) for n, i in enumerate(ids)]
    rows += [(ids[0], None), (ids[1], ""), (ids[2], "one")]
    want = []
    for i, text in rows:
        words = [w.decode() for w in split(text)]
        if i is not None and words and zlib.crc32(str(i).encode()) % 10 == 0:
            g, n = zlib.crc32(str(i).encode()) // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        runs = brute(words)
        gone = {k for s, n, d in runs for k in range(s + d, s + n)}
        best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if runs else (None,) * 3
        want.append(
            (
                i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                hashlib.sha256("".join(f"{s},{n},{d}\n" for s, n, d in runs).encode()).hexdigest(),
                hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest(),
            )
        )
    got = periodic_runs.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.n_runs > 0 for r in got) > 20
