"""Connected components of links as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.session import written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b.

    Each node's neighbours are hung onto the smallest of them. The large step moves
    the neighbours above the node, the small step those below it and the node.
    """
    both = edges if not larger else edges.union(edges.select(F.col("b"), F.col("a")).toDF("a", "b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    moved = both.join(low, "a")
    if larger:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        return moved.where("a > b").distinct()
    hung = moved.where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return hung.union(low.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node in `links` (a, b); component is the smallest node.

    Large and small star steps alternate until no edge moves. A node without links
    has no row. Null ends are ignored; loops and repeated links change nothing.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.distinct(), label)
    state = None
    while True:
        edges = written(_star(_star(edges, True), False), label)
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))
        ).first()
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b", "b").toDF("node", "component")).distinct()
