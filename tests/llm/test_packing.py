"""Packing against whole encodings and a step-by-step round-robin."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ordina.llm import packing

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    t.encode_special_tokens = True
    return t


def check_whole(rows, docs, tokenizer, window=packing.WINDOW):
    """Each id lies in one piece; sequences are gapless and full, or a power of two."""
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(ids[d][at : at + p.length])
            at += p.length
        assert at == len(ids[d])
    total = 0
    for k, pieces in by_sequence.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and (at == window or at & (at - 1) == 0)
        total += at
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert total == sum(map(len, ids.values()))


def test_given_documents(spark, tokenizer):
    import __spark_entry__ as entry_points

    rows = entry_points.queries()["op6_packing"](spark, SF_DIR).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    check_whole(rows, docs, tokenizer)


def test_edge_cases(spark, tokenizer):
    texts = [None, "", " ", "a\tb\r\n c", "<|endoftext|> x", "café don't 12 km", " q　r", "wort " * 30_000, "x" * 20_000]
    docs = [(i, t, None if i % 2 else "s", "k") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, part string").repartition(3)
    check_whole(packing.pack(frame).collect(), [d[:2] for d in docs], tokenizer)
    assert packing.pack(frame.limit(0)).count() == 0
    repeated = spark.createDataFrame([(None, "a", "s"), (1, "a", "s"), (1, "a", "s")], "doc_id long, text string, source string")
    assert sorted(r.length for r in packing.pack(repeated).collect()) == [2, 2, 2]


@pytest.mark.parametrize("weights", [[1, 1, 1], [5, 2, 1], [0.2, 3, 0.01]])
def test_windows_keep_the_mixture(weights):
    """The closed form against rounds that carry deficits step by step."""
    totals, w = np.array([900, 5_000, 70]), np.array(weights, float)
    rounds = packing.Rounds(totals, w / w.sum(), 64)
    taken = rounds.taken(np.arange(0, totals.sum() // 64 + 2))
    assert (np.diff(taken, axis=0) >= 0).all() and (taken[-1] == totals).all()
    assert (np.diff(taken, axis=0)[:-1].sum(axis=1) == 64).all()
    share, before = w / w.sum(), taken[0]
    for k, now in enumerate(taken[1:], 1):
        if (now < totals).all():
            assert (abs(now - k * 64 * share) <= 1.0 + 1e-6).all()


def test_pieces_of_random_queues():
    rng = np.random.default_rng(3)
    for _ in range(30):
        queues, docs = int(rng.integers(1, 6)), int(rng.integers(1, 60))
        queue, tokens = rng.integers(0, queues, docs), rng.integers(1, 300, docs)
        totals = np.bincount(queue, tokens, queues).astype(int)
        used = np.flatnonzero(totals)
        queue = np.searchsorted(used, queue)
        totals = totals[used]
        first = np.zeros(docs, int)
        for q in range(len(totals)):
            on = queue == q
            first[on] = np.cumsum(tokens[on]) - tokens[on]
        rounds = packing.Rounds(totals, rng.random(len(totals)) + 0.01, 32)
        number, start, length, sequence, offset = packing.pieces(rounds, queue, first, tokens)
        assert (np.bincount(number, length, docs) == tokens).all()
        for s in np.unique(sequence):
            on = np.argsort(offset[sequence == s])
            x, y = offset[sequence == s][on], length[sequence == s][on]
            assert (x == np.cumsum(y) - y).all() and (y.sum() == 32 or bin(y.sum()).count("1") == 1)
