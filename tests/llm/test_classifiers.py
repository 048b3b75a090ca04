"""Language identification and toxicity: held-out accuracy and edge cases."""

from __future__ import annotations

import zlib

import __spark_entry__ as entry_points
import numpy as np
from ordina.llm import language_id as lid
from ordina.llm import toxicity as tox

SF_DIR = "/root/testdata/sf0.01"
EDGE = [(1, None, "en", 5, 5), (2, "", None, 5, 5), (3, "12 !!", "en", 5, 5), (None, "the dog", "en", 5, 5), (4, "Ünd " * 100_000, None, 5, 5), (1, None, "en", 5, 5)]
SCHEMA = "doc_id long, text string, lang string, score int, cells int"
TRAIN = [i for i in range(5, 40) if zlib.crc32(str(i).encode()) % 4 != 2][:2]


def is_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_on_held_out(spark):
    rows = entry_points.queries()["op2_language_id"](spark, SF_DIR).collect()
    given = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(rows) == len(given)
    assert all(r.held_out == is_held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    right = [r.lang_pred == given[r.doc_id].lang for r in rows if r.held_out]
    assert np.mean(right) >= 0.97


def test_language_ignores_held_out_lang(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    other = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 'zz' ELSE lang END AS lang")
    assert sorted(map(tuple, lid.identify(docs).collect())) == sorted(map(tuple, lid.identify(other).collect()))


def test_language_counts(spark):
    """Scores follow from the counts of a plain Python loop."""
    texts = ["the cat and the dog", "le chat et le chien", "der hund und die katze", "le chien"]
    model = lid.Model(["a"], np.zeros((1, lid.CELLS)), np.ones(1))
    plain = lid.letters(texts[0])
    assert plain == " the cat and the dog "
    n = sum(len(c) for c in lid.cells(plain))
    assert n == sum(len(plain) - k + 1 for k in lid.ORDERS)
    long = "ab " * lid.STEP
    whole = sum(len(c) for c in lid.cells(long))
    assert whole == sum(len(long) - k + 1 for k in lid.ORDERS)
    assert model.score(texts)[0] == ["a"] * 4


def test_language_edge_cases(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    got = lid.identify(docs).collect()
    assert len(got) == len(EDGE) and {r.lang_pred for r in got} == {"und"}
    docs = docs.union(spark.createDataFrame([(TRAIN[0], "the dog", "en", 1, 1), (TRAIN[1], "le chat", "fr", 1, 1)], SCHEMA))
    by_id = {r.doc_id: r for r in lid.identify(docs).collect()}
    assert by_id[1].lang_pred == by_id[2].lang_pred == by_id[3].lang_pred == "und" and by_id[3].score == 0
    assert by_id[None].lang_pred == "en" and not by_id[None].held_out
    kept = lid.keep_identified(docs)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} >= set(TRAIN)
    assert lid.identify(docs.limit(0)).count() == 0


def test_toxicity_on_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = entry_points.queries()["op8_toxicity"](spark, sf_dir).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == is_held(r.doc_id) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    y, p = np.array(held).T
    assert p[y == 1].mean() >= 0.85 and p[y == 0].mean() <= 0.01


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    labels = spark.createDataFrame([(1, 0), (9, 1), (9, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = tox.score_toxicity(docs, labels).collect()
    assert len(got) == len(EDGE) and not any(r.predicted for r in got)
    kept = tox.keep_harmless(docs, labels)
    assert kept.schema == docs.schema and kept.count() == len(EDGE)
    assert tox.score_toxicity(docs.limit(0), labels).count() == 0
    assert tox.score_toxicity(docs, labels.limit(0)).count() == len(EDGE)


def test_risk_step_back():
    """The classifier finds a marker that only positives have among many unlabelled texts."""
    rng = np.random.default_rng(0)
    rows, positive = [], []
    for i in range(600):
        toxic = i % 6 == 0
        cells = rng.choice(np.arange(100, 400), 40, replace=False)
        rows.append(np.append(cells, 7 if toxic else 8).astype(np.int32))
        positive.append(toxic and i % 2 == 0)
    positive = np.array(positive)
    model = tox.fit(rows, positive, ~positive, 1 / 6)
    assert model.weights[7] > 1 > abs(model.weights.get(8, 0.0)) - 3
