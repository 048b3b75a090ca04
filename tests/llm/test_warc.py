"""WARC archives: exact round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import __spark_entry__ as entry_points
import pytest
from ordina.llm import warc

SF_DIR = "/root/testdata/sf0.01"


def brute(rows, least=0):
    body = {i: (h or "").encode() for i, (_, h) in enumerate(rows)}
    best = {}
    for i, (page, _) in enumerate(rows):
        if page is not None:
            best[body[i]] = max(best.get(body[i], page), page)
    out = []
    for i, (page, _) in enumerate(rows):
        b, to = body[i], best.get(body[i])
        revisit = len(b) >= least and to is not None and page != to
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((page, len(b), digest, "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    html = [None, "", "a", "a", "\r\n\r\nWARC/1.1\r\n", "x" * 3_000_000, "x" * 3_000_000, "é", "same text", "same text", "a"]
    rows = [(i if i != 9 else 8, h) for i, h in enumerate(html)] + [(None, "a"), (None, "lonely"), (None, "lonely")]
    pages = spark.createDataFrame([(p, "u\n v", h, 1, "n") for p, h in rows], "page_id long, url string, html string, bytes int, name string")
    got = warc.round_trip(pages.repartition(2), least).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, least)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_given_pages(spark):
    got = entry_points.queries()["op5_warc"](spark, SF_DIR).collect()
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()]
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)


def test_normaliser_makes_members(spark, tmp_path):
    """Archives go in as one gzip stream and come out with a member for each record."""
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").limit(40).coalesce(1)
    raw, clean = f"file://{tmp_path}/raw", f"{tmp_path}/clean"
    archives = warc.write_archives(pages, raw)
    members = warc.normalise(archives, raw, clean).collect()
    assert sum(m.records for m in members) == 40
    for m in members:
        before = (tmp_path / "raw" / m.name).read_bytes()
        after = (tmp_path / "clean" / m.name).read_bytes()
        one = zlib.decompressobj(warc.GZIP)
        one.decompress(before)
        assert one.eof and not one.unused_data and len(after) == m.bytes
        assert gzip.decompress(after) == gzip.decompress(before)
        n, rest = 0, after
        while rest:
            member = zlib.decompressobj(warc.GZIP)
            assert member.decompress(rest).startswith(b"WARC/1.1\r\n")
            n, rest = n + 1, member.unused_data
        assert n == m.records


def test_broken_streams():
    whole = warc.record("urn:page:1", "u", "response", b"abc", warc.digest_of(b"abc"), 3, None)
    data = gzip.compress(whole)
    assert [r for _, r in warc.records(warc.inflated(iter([data[:7], data[7:], data])))] == [whole, whole]
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(iter([data[:-20]]))))
    with pytest.raises(ValueError):
        list(warc.records(iter([whole[:-3]])))


def test_mostly_null_pages_and_as_many_tasks_as_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 20)
    rows = [(i, None if i % 10 else f"page {i % 30}") for i in range(400)]
    pages = spark.createDataFrame([(p, "u", h) for p, h in rows], "page_id long, url string, html string").repartition(6)
    got = warc.round_trip(pages)
    archives = got.select("archive").distinct().count()
    assert archives >= 20 and got.rdd.getNumPartitions() == archives
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(rows)


def test_names_are_dealt_even_if_their_number_is_that_of_shuffle_partitions(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = spark.range(n).selectExpr("concat('file-', id) AS name")
    assert warc._dealt(names).rdd.getNumPartitions() == n
    plan = warc._dealt(names)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
