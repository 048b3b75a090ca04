"""Tables that are replaced together."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from ordina.plans import store
from ordina.sources import tables, versions


def rows(spark, tag):
    frame = spark.createDataFrame([("a", 1, "v, t"), ("b", 0, "t, v"), ("c", None, None)], "id string, sii int, fold_info string")
    return frame.withColumn("tag", F.lit(tag))


def tags(spark, *paths):
    return [sorted({r.tag for r in tables.scan_table(spark, p).collect()}) for p in paths]


def test_a_pair_is_replaced_at_once(spark, tmp_path):
    gold, rest = str(tmp_path / "gold"), str(tmp_path / "rest")
    for tag in ("old", "new"):
        tables.publish_gold(rows(spark, tag), "sii", gold, rest)
        assert tags(spark, gold, rest) == [[tag], [tag]]
    assert tables.scan_table(spark, rest).columns == ["id", "sii", "tag"]
    assert sorted(r.id for r in tables.scan_table(spark, gold).collect()) == ["a", "b"]
    assert versions.drop_old(spark, gold) == 1
    assert tags(spark, gold, rest) == [["new"], ["new"]]


@pytest.mark.parametrize("survives", [0, 1])
def test_a_job_killed_between_the_writes_leaves_the_old_pair(spark, tmp_path, monkeypatch, survives):
    gold, rest = str(tmp_path / "gold"), str(tmp_path / "rest")
    tables.publish_gold(rows(spark, "old"), "sii", gold, rest)
    write, done = DataFrameWriter.parquet, []

    def killed(self, path, *args, **options):
        if len(done) == survives:
            raise KeyboardInterrupt
        done.append(path)
        return write(self, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", killed)
    with pytest.raises(KeyboardInterrupt):
        tables.publish_gold(rows(spark, "new"), "sii", gold, rest)
    monkeypatch.undo()
    assert len(done) == survives and tags(spark, gold, rest) == [["old"], ["old"]]
    tables.publish_gold(rows(spark, "newer"), "sii", gold, rest)
    assert tags(spark, gold, rest) == [["newer"], ["newer"]]


def test_a_job_killed_before_the_pointer_leaves_the_old_pair(spark, tmp_path, monkeypatch):
    gold, rest = str(tmp_path / "gold"), str(tmp_path / "rest")
    tables.publish_gold(rows(spark, "old"), "sii", gold, rest)

    def killed(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "_put_json", killed)
    with pytest.raises(KeyboardInterrupt):
        tables.publish_gold(rows(spark, "new"), "sii", gold, rest)
    assert tags(spark, gold, rest) == [["old"], ["old"]]


def test_results_and_plain_tables(spark, tmp_path):
    frames = {"oof": rows(spark, "x"), "thresholds": rows(spark, "y")}
    tables.publish_results(frames, str(tmp_path / "published"))
    tables.sink_results(frames, str(tmp_path / "plain"))
    for root in ("published", "plain"):
        read = store.read_results(spark, str(tmp_path / root), list(frames))
        assert {n: df.first().tag for n, df in read.items()} == {"oof": "x", "thresholds": "y"}
    assert versions.drop_old(spark, str(tmp_path / "plain")) == 0
