"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.lineage import checkpoint_dir, cut

__all__ = ["FirstSeen", "Words", "binary_column", "checkpoint_dir", "cut", "cut_dealt", "mix64", "table", "text_bytes"]


def cut_dealt(df: DataFrame) -> DataFrame:
    """A checkpoint that later joins on the same key read as it lies.

    Adaptive plans don't tell how their result is dealt, so this one plan is made without.
    """
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return cut(df)
    finally:
        conf.set(key, before)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class FirstSeen(dict):
    """Computes a value at its first use.  ``bound`` entries at most; then it starts again empty."""

    def __init__(self, make, bound: int = 300_000):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Words(dict):
    """Values of words that are computed for many new words at once."""

    def __init__(self, make_all, bound: int = 300_000):
        super().__init__()
        self.make_all, self.bound = make_all, bound

    def ensure(self, words) -> None:
        words = set(words)
        new = [w for w in words if w not in self]
        if new and len(self) + len(new) > self.bound:
            self.clear()
            new = list(words)
        if new:
            self.update(zip(new, self.make_all(new), strict=True))


def binary_column(batch: pa.RecordBatch, at: int) -> list:
    """A text column as UTF-8 bytes, nulls as None."""
    return batch.column(at).cast(pa.binary()).to_pylist()


def text_bytes(col: str):
    """Bytes of the text in UTF-8; null counts as none."""
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("bigint")
