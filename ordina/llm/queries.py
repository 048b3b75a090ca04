"""The corpus operators as queries over the given tables, with SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordina.llm import (
    decontamination,
    jaccard_join,
    language_id,
    license_scan,
    merkle,
    packing,
    periodic_runs,
    quality_rules,
    quotations,
    slack_packing,
    toxicity,
    url_rules,
    warc,
)
from ordina.llm.common import read_table
from ordina.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op7_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(read_table(spark, sf_dir, "documents"))


@query("op7_jaccard_links")
def op7_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(read_table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op3_quality_rules", quality_rules.ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(read_table(spark, sf_dir, "documents")))


@query("quality_ablations", quality_rules.ABLATIONS_ORACLE)
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule of every policy removes, from the bits of a written ledger."""
    bits = written(quality_rules.ledger(read_table(spark, sf_dir, "documents")).select("doc_id", "fail_bits"), "ledger")
    return quality_rules.ablations(bits)


@query("op4_url_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels name pages by id; a page is bad if it is toxic or of low quality."""
    labels = read_table(spark, sf_dir, "labels")
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    return url_rules.judge(read_table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


@query("op5_warc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages")).drop("archive")


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


@query("op10_quotations")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link(read_table(spark, sf_dir, "conversations"))


@query("op11_merkle_manifest", merkle.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read_table(spark, sf_dir, "documents"))


@query("op12_periodic_runs", periodic_runs.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(read_table(spark, sf_dir, "documents"))


@query("op13_slack_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.pack(read_table(spark, sf_dir, "documents"))
