"""Connected components by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import cut


def _stars(edges: DataFrame) -> bool:
    """True if each node points to one smaller node at most, and none to a node that points on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node of each component, from edges ``(a, b)`` of integers.

    Only nodes with an edge to another node are returned.  Each round points all neighbours of a node to the
    smallest one, first the larger neighbours, then the smaller ones; the rounds end when all components are stars.  Only
    minima and narrow rows are shuffled, so a node with very many edges is pre-aggregated in each task.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(least, "a")
        small = (
            joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(least.select("a", F.col("low").alias("b")))
        )
        now = cut(small.distinct())
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
