"""Numbers of links against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ordina.llm import jaccard_join as jj

SF_DIR = "/root/testdata/sf0.001"


def sets_of(texts):
    return [jj.shingle_set((t or "").encode().lower().split()) for t in texts]


def linked(a, b):
    return bool(a) and 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    texts = sorted({t for _, t in rows if t})
    sets = sets_of(texts)
    n = {t: sum(linked(s, x) for x in sets) - bool(s) for t, s in zip(texts, sets)}
    return sorted(((d, n.get(t, 0)) for d, t in rows), key=str)


def counted(spark, rows):
    got = jj.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted(((r.doc_id, r.n_links) for r in got), key=str)


def family(n, seed, length=90):
    """Texts that differ in a word near one end: many links, and none between the longest and the shortest."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(length)]
    rows = []
    for i in range(n):
        mine = words[: length - rng.randrange(25)]
        mine[-1 - rng.randrange(6)] = f"own{i}"
        rows.append((i, " ".join(mine)))
    return rows


def test_three_near_copies(spark):
    rows = family(3, 1, 200)
    assert counted(spark, rows) == [(0, 2), (1, 2), (2, 2)]


@pytest.mark.parametrize("block", [16, 512])
def test_large_class(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    rows = family(150, 2) + [(1000 + i, t) for i, t in family(40, 3, 30)] + [(2000, "A b c"), (2001, "a  b c"), (2001, "a  b c"), (None, "a b c")]
    rows += [(3000, None), (3001, ""), (3002, "nothing like it anywhere else here")] + family(150, 2)[:5]
    want = brute(rows)
    assert len({n for _, n in want}) > 10 and counted(spark, rows) == want
    classes = jj.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = jj.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, (tuple(r)[:3] for r in got))) == sorted(map(str, map(tuple, classes)))
    assert jj.jaccard_links(spark.createDataFrame(rows[:0], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("two_sides", [False, True])
def test_cell_against_pairs(two_sides):
    texts = [t.encode() for _, t in family(600, 4)]
    sets = sets_of([t.decode() for t in texts])
    weight = np.arange(1, len(texts) + 1)
    side = np.arange(len(texts)) % 2 if two_sides else np.full(len(texts), 2)
    want = np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        for j in range(i):
            if (not two_sides or side[i] != side[j]) and linked(sets[i], sets[j]):
                want[i] += weight[j]
                want[j] += weight[i]
    assert (jj._cell_links(texts, side, weight) == want).all()


def test_links_of_given_documents(spark):
    import __spark_entry__ as entry_points

    out = entry_points.queries()["op7_jaccard_links"](spark, SF_DIR).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.n_links) for r in out), key=str) == brute(rows)
