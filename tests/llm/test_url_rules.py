"""URL rules: stated ones against a loop, mined ones against all subsets."""

from __future__ import annotations

import re
from itertools import combinations

import __spark_entry__ as entry_points
from ordina.llm import url_rules as ur
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.01"


def parts(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    return (m[2].translate({c: c + 32 for c in range(65, 91)}), m[3]) if m else ("", "")


def stated(host, path):
    fits = [
        (len(h + p), h + p, v)
        for v, h, p in ur.STATED
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "https://WWW.Example.com/en/a?x=1",
    "http://a.www.example.com/en/",
    "http://example.com/en/q#f",
    "http://notexample.com/en/",
    "http://x.net/es/1",
    "http://x.net/esp",
    "net/es/",
    "://net/fr/x://com/",
    "http://com",
    "http://com/",
    "a?b://example.com/en/",
    "HTTP://EXAMPLE.COM/EN/",
    "",
    None,
    "http://\u00c9X.net\n/es/",
    "http://user.org/" + "p/" * 40_000,
]


def test_stated_rules(spark):
    pages = spark.createDataFrame([(i // 2, u, 1, "k") for i, u in enumerate(URLS)], "page_id long, url string, host int, token string")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    rows = ur.judge(pages, labels).collect()
    want = []
    for i, u in enumerate(URLS):
        h, p = parts(u)
        rule, verdict = stated(h, p)
        want.append((i // 2, h, p, rule, verdict or "allow"))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    assert ur.judge(pages.limit(0), labels).count() == 0


def test_mined_rules(spark):
    """Every frequent and sure token set up to the length bound, and only these, by counting all subsets."""
    rows, marks = [], []
    for i in range(400):
        spam = i % 10 == 0
        rows.append((i, f"http://{'cheap' if spam or i % 7 == 0 else 'news'}.org/{'pills' if spam else 'today'}/{i}?id={i}"))
        marks.append((i, spam))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([*marks, (3, None), (None, True), (0, False)], "page_id long, bad boolean")
    got = {frozenset(r.tokens) for r in ur.mine(pages, labels).collect()}
    token_sets = [set(r.t) for r in pages.orderBy("page_id").select(ur.tokens_of(F.col("url")).alias("t")).collect()]
    bad = [m[1] for m in marks]
    share = sum(bad) / len(bad)
    want = set()
    for n in range(1, ur.LONGEST + 1):
        for some in combinations(sorted(set().union(*token_sets)), n):
            on = [set(some) <= t for t in token_sets]
            both = sum(a and b for a, b in zip(on, bad))
            if both >= ur.LEAST_SUPPORT * len(bad) and both and both / sum(on) >= max(ur.LEAST_CONFIDENCE, ur.LEAST_LIFT * share):
                want.add(frozenset(some))
    assert got == want and want
    judged = {r.page_id: r for r in ur.judge(pages, labels).collect()}
    for i, t in enumerate(token_sets):
        assert judged[i].verdict == ("block" if any(w <= t for w in want) else "allow")


def test_given_pages(spark):
    rows = entry_points.queries()["op4_url_rules"](spark, SF_DIR).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        rule, verdict = stated(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined else "allow"))
