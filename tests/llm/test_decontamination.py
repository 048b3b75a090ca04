"""Template windows on planted questions, and against plain matching."""

from __future__ import annotations

import __spark_entry__ as entry_points
from ordina.llm import decontamination as dc

SF_DIR = "/root/testdata/sf0.001"
ITEM = "Yesterday the farmer Anna Miller sold 12 kg of red apples and then 30 more to Robert near the old market hall."


def judged(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, item string, hash int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    return {r.doc_id: r for r in dc.judge(docs, bench).collect()}


def test_reparameterised_question(spark):
    texts = [
        "Before. " + ITEM + " After it came other things.",
        ITEM.replace("12 kg", "45 lbs").replace("30", "7").replace("Anna Miller", "Bob").replace("Robert", "Sue Ann Lee"),
        ITEM.lower(),
        "Yesterday the farmer went home and sold nothing of red apples then near the market hall.",
        None,
        "",
        "word " * 200_000 + ITEM,
        "12 30 45 7 8 9 10 11 12 13 14 15",
    ]
    got = judged(spark, texts, [ITEM, "too short", None, ITEM])
    assert [got[i].contaminated for i in range(8)] == [True, True, True, False, False, False, True, False]
    assert [got[i].rewritten for i in range(3)] == [False, True, False]
    assert all(got[i].item_id == 0 for i in (0, 1, 2, 6)) and got[0].n_items == 1


def test_values_must_stay_the_same(spark):
    item = "If a train needs 40 minutes for one way then after 40 minutes it has gone there and 40 minutes later back."
    good, torn = item.replace("40", "55"), item.replace("40", "55", 1).replace("40", "56")
    got = judged(spark, [good, torn, item], [item])
    assert got[0].contaminated and got[0].rewritten
    assert not got[1].contaminated
    assert got[2].contaminated and not got[2].rewritten


def test_empty_tables(spark):
    assert judged(spark, [], [ITEM]) == {}
    assert not judged(spark, ["a b c " * 20], [])[0].contaminated
    docs = spark.createDataFrame([(None, ITEM), (None, "clean"), (1, ITEM), (1, ITEM), (1, "b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id int, text string")
    assert sorted(r.contaminated for r in dc.judge(docs, bench).collect()) == [False, False, True, True, True]
    assert sorted(r.text for r in dc.keep_clean(docs, bench).collect()) == ["b", "clean"]


def test_given_documents(spark):
    """The items have neither numbers nor names inside sentences: plain 8-word windows must agree."""
    rows = entry_points.queries()["op1_decontamination"](spark, SF_DIR).collect()

    def windows(text):
        words = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in text.lower().split()]
        words = [w for w in words if w]
        return {tuple(words[i : i + 8]) for i in range(len(words) - 7)}

    bench = set().union(*(windows(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()))
    want = {r.doc_id: bool(windows(r.text) & bench) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert sum(want.values()) > 0
    assert {r.doc_id: r.contaminated for r in rows} == want


def test_names_of_its_own_may_be_taken(spark):
    docs = spark.createDataFrame([(1, ITEM, 5, 6), (2, "clean", 5, 6)], "doc_id long, text string, _id long, _HASH long")
    bench = spark.createDataFrame([(1, ITEM)], "item_id int, text string")
    kept = dc.keep_clean(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean", 5, 6)]
