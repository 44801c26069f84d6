"""Cutting lineage through the checkpoint folder of the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The configured checkpoint folder; a private one only for local sessions that have none."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-veil-"))
        return sc.getCheckpointDir()
    return None


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``; without a checkpoint folder the plan itself."""
    return df.checkpoint() if checkpoint_dir(df.sparkSession) else df


def fits(df: DataFrame, max_rows: int) -> bool:
    """True if the frame has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows
