"""Jaccard join against all pairs."""

from __future__ import annotations

import random

import pytest

from ordina.llm import jaccard_join as jj

SF_DIR = "/root/testdata/sf0.001"


def brute(rows):
    sets = [jj.shingle_set((t or "").encode().lower().split()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, jj.jaccard_classes(docs).collect()), key=str)


def near_copies(seed, n, families, length):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocab, k=60)
    rows = []
    for i in range(n):
        if i < families:
            words = rng.choices(vocab, k=rng.choice(length))
            if rng.random() < 0.4:
                at = rng.randrange(len(words) + 1)
                words[at:at] = passage
        else:
            words = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            if rng.random() < 0.3:
                words = words[rng.randrange(0, max(1, len(words) // 8)) :]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed,length", [(1, [6, 9, 12, 20]), (2, [30, 60, 90]), (3, [150, 400])])
def test_all_links(spark, seed, length, monkeypatch):
    monkeypatch.setattr(jj, "SAMPLE_SETS", 8_000)
    rows = near_copies(seed, 260, 90, length)
    assert result(spark, rows) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "A B  C"), (None, "a b c"), (6, "a b c d"), (6, "a b c d")]
    rows += [(None, "x y"), (9, "one two three four five six"), (8, "one two three four five\u00a0six")]
    long = " ".join(f"t{i}" for i in range(30_000))
    rows += [(20, long), (21, long + " tail"), (22, None)]
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, node long, key long")
    assert jj.jaccard_classes(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, 6, "q"), (2, "a b", 5, 6, "q")], "doc_id long, text string, node long, a long, b string")
    kept = jj.one_of_each(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_pigeonhole_keys():
    """Linked sets always share a key, with and without frequent shingles."""
    import numpy as np

    rng = np.random.default_rng(5)
    for trial in range(1500):
        n = int(rng.choice([4, 5, 6, 7, 8, 10, 13, 17, 25, 40, 90, 200]))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        extra = int(rng.integers(0, n // 4 + 1))
        gone = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 1 << 63, extra, dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        if 5 * both < 4 * len(np.union1d(a, b)):
            continue
        share = rng.choice([0.0, 0.3, 0.9, 1.0])
        common = np.sort(rng.permutation(a)[: int(share * len(a))])
        if len(common) == 0:
            common = np.empty(0, np.uint64)
        assert len(np.intersect1d(jj.keys_of(a, common), jj.keys_of(b, common))) or np.array_equal(a, b)


def test_query_on_given_documents(spark):
    import __spark_entry__ as entry_points

    out = entry_points.queries()["op7_jaccard_join"](spark, SF_DIR)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_names_of_its_own_may_be_taken(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7), (2, "a b", 5, 6, 7)], "doc_id long, text string, _hash long, _kept long, _ID long")
    kept = jj.one_of_each(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b", 5, 6, 7)]


def candidates(n, tried, room):
    """Pairs that a key offers for n sets alike by size and bitmap, each its own component."""
    import pyarrow as pa

    rows = {
        "key": pa.array([7] * n), "node": pa.array(range(n)), "component": pa.array(range(n)),
        "n": pa.array([40] * n), "bitmap": pa.array([bytes(jj.BITS // 8)] * n, pa.binary()),
        "tried": pa.array([tried.get(i) for i in range(n)], pa.list_(pa.int64())),
    }
    found = jj._across_components(room)([pa.RecordBatch.from_pydict(rows)])
    return [(a, b) for batch in found for a, b, key in zip(*(c.to_pylist() for c in batch.columns)) if key is None]


def test_a_key_offers_a_forest_of_its_sets():
    pairs = candidates(300, {}, 0)
    assert len(pairs) == 299 and {n for p in pairs for n in p} == set(range(300))
    # A pair that failed is not tried again, others take its place.
    again = candidates(300, {b: [b - 1] for b in range(1, 300)}, 0)
    assert len(again) == 299 and all(b - a > 1 for a, b in again)
    # With more room every pair is met in the end, once.
    every = candidates(20, {}, 64)
    assert len(every) == len(set(every)) == 190


def test_near_copies_around_texts_that_are_far_from_each_other(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(60), 3):
            words[at] = f"x{rng.randrange(6)}"
        rows.append((i, " ".join(words)))
    assert result(spark, rows) == brute(rows)
