"""Mined url rules with many bad labels, and rules that need many tokens."""

from __future__ import annotations

from itertools import combinations

from ordina.llm import url_rules as ur


def verdicts(spark, rows):
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, bad) for i, (_, bad) in enumerate(rows)], "page_id long, bad boolean")
    return [r.verdict for r in sorted(ur.judge(pages, labels).collect(), key=lambda r: r.page_id)]


def test_most_labels_bad(spark):
    """At a share of 0.6 no rule can reach a lift of 2."""
    rows = [(f"http://{'cheap' if i % 5 < 3 else 'news'}.org/x", i % 5 < 3) for i in range(100)]
    assert verdicts(spark, rows) == ["block" if bad else "allow" for _, bad in rows]


def test_rule_of_five_tokens(spark):
    """Five words together are bad; any four of them are not."""
    words = ["aa", "bb", "cc", "dd", "ee"]
    bad = [("x://y/" + "/".join(words), True)] * 10
    good = [("x://y/" + "/".join(some), False) for some in combinations(words, 4) for _ in range(10)]
    rows = bad + good
    assert verdicts(spark, rows) == ["block" if on else "allow" for _, on in rows]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(i, on) for i, (_, on) in enumerate(rows)], "page_id long, bad boolean")
    # Longer sets that hold the five words say nothing more.
    assert [r.tokens for r in ur.mine(pages, labels).collect()] == [[f"p:{w}" for w in words]]
