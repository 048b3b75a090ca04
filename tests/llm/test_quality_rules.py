"""The quality ledger against a plain loop and SQL."""

from __future__ import annotations

import re
from collections import Counter

import __spark_entry__ as entry_points
import oracle
import pytest
from ordina.llm import quality_rules as qr

TEXTS = [
    None,
    "",
    " \n\t",
    "a b a b a b",
    "x y z x y z x y z w",
    "one\none\n \n \none\ntwo",
    "## $$ | a b <c>",
    "é" * 10 + " 日本 \U0001f600",
    "w " * 3000,
    " ".join(f"t{i}" for i in range(30_000)) + " t1 t2 t3",
    "same line of words here\n" * 60,
]


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    places = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(places) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(places), failed


def test_measurements(spark):
    docs = spark.createDataFrame([(i % 5, t, 9, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, words int, n_words string")
    rows = qr.apply_policy(qr.ledger(docs)).collect()
    want = sorted((i % 5, *brute(t)) for i, t in enumerate(TEXTS))
    assert sorted(tuple(r)[:7] for r in rows) == want
    assert not any(r.kept for r in rows if r.base_failed)
    assert qr.ledger(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_matches_sql(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    con = oracle.connect(sf_dir)
    sql = entry_points.oracle_sql()["op3_quality_rules"]
    assert oracle.differences(entry_points.queries()["op3_quality_rules"](spark, sf_dir), con, sql) == []


def test_ablations(spark):
    rows = qr.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    bits = [r.fail_bits for r in rows.collect()]
    got = {(r.policy, r.rule): (r.n_kept, r.n_kept_without, r.only_this) for r in qr.ablations(rows).collect()}
    assert len(got) == sum(map(len, qr.POLICIES.values()))
    for (policy, rule), found in got.items():
        m, b = qr.mask(qr.POLICIES[policy]), qr.bit(rule)
        assert found == (sum(not x & m for x in bits), sum(not x & m & ~b for x in bits), sum(x & m == b for x in bits))


def test_no_python_in_plan(spark, capsys):
    qr.apply_policy(qr.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_verdict_follows_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    kept = {r.doc_id: (r.kept, r.base_failed) for r in entry_points.queries()["op3_quality_rules"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [kept[r.doc_id][0] for r in labels if r.quality == 1 and not kept[r.doc_id][1]]
    bad = [kept[r.doc_id][0] for r in labels if r.quality == 0]
    assert sum(good) / len(good) > 0.995 and sum(bad) / len(bad) < 0.01
