"""Packing by minimum bin slack against whole encodings, and its DP against all combinations."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ordina.llm import slack_packing

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path(slack_packing.VOCABULARY))
    t.encode_special_tokens = True
    return t


def check_whole(rows, docs, tokenizer, capacity=slack_packing.CAPACITY, end=0):
    """Each document's ids lie in its pieces in order; sequences are gapless and hold at most `capacity`."""
    want = Counter()
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want[d, k, at, len(cut), zlib.crc32(cut)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_given_documents(spark, tokenizer):
    import __spark_entry__ as entry_points

    rows = entry_points.queries()["op13_slack_packing"](spark, SF_DIR).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    used, least = check_whole(rows, docs, tokenizer)
    assert used <= least + 1


def test_edge_cases(spark, tokenizer):
    texts = [None, "", " ", "a\tb\r\n c", "<|endoftext|> x", "don't 12 km", "wort " * 30_000, "x" * 20_000, "wort " * 2047, "wort " * 2048]
    texts += ["İSTANBUL İ. TAKSİ! EVLİLİĞİ, sonra"] * 3
    docs = [(None if i % 4 == 3 else i, t, i, "k") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, length int, sequence_id string").repartition(3)
    check_whole(slack_packing.pack(frame).collect(), [d[:2] for d in docs], tokenizer)
    assert slack_packing.pack(frame.limit(0)).count() == 0


def test_another_vocabulary_gets_whole_texts(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = [(i, s) for i, s in enumerate(["Two  words.\n\nAnd more", "", " leading", "x " * 300])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    check_whole(slack_packing.pack(frame, "byte_bpe_50k.json", 64, 9).collect(), docs, t, 64, 9)


@given(st.dictionaries(st.integers(1, 12), st.integers(0, 3), max_size=4), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_fullest_combination(counts, room):
    """The sum against all combinations."""
    lengths = list(counts)
    sums = [
        sum(n * k for n, k in zip(lengths, some))
        for some in itertools.product(*(range(counts[n] + 1) for n in lengths))
    ]
    taken = slack_packing.fullest(counts, room)
    assert all(0 < k <= counts[n] for n, k in taken.items())
    assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)


def test_plan_removes_what_single_bins_would():
    """Combinations that are taken many times at once against one bin after another."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        counts = {int(n): int(k) for n, k in zip(rng.integers(1, 65, 12), rng.integers(1, 40, 12))}
        plan = slack_packing.combinations(counts, 64)
        left, bins = Counter(counts), []
        while left:
            largest = max(left)
            left[largest] -= 1
            taken = slack_packing.fullest(left, 64 - largest)
            left -= Counter(taken)
            taken[largest] = taken.get(largest, 0) + 1
            bins.append(taken)
        assert [taken for k, taken in plan for _ in range(k)] == bins
        assert sum(k * sum(t.values()) for k, t in plan) == sum(counts.values())


def test_each_place_is_given_once():
    counts = {64: 3, 40: 7, 24: 9, 13: 11, 1: 100}
    found, seen = slack_packing.places(slack_packing.combinations(counts, 64)), Counter()
    for length, k in counts.items():
        for b, o in zip(*found[length].of(length, np.arange(k))):
            seen.update((int(b), x) for x in range(int(o), int(o) + length))
    assert set(seen.values()) == {1} and max(x for _, x in seen) < 64


def test_plan_is_small_for_any_number_of_pieces():
    counts = {n: 10**12 // n for n in range(1, slack_packing.CAPACITY + 1)}
    plan = slack_packing.combinations(counts)
    assert len(plan) < 3 * slack_packing.CAPACITY
    least = -(-sum(n * k for n, k in counts.items()) // slack_packing.CAPACITY)
    assert sum(k for k, _ in plan) <= 1.0001 * least
