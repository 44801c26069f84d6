"""Ordered walks: a fold over the rows of each key in order, with state that does not grow with the key.

Rows are hash-partitioned by key and sorted inside the partition; Arrow batches stream through one
generator per partition.  A key is never gathered in memory, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def tasks(spark: SparkSession) -> int:
    """Parts for rows that cost much time and few bytes, which Spark would put together by their bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ordered_walk(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[], object],
    step: Callable[[object, dict], list[tuple]],
    finish: Callable[[object, tuple], list[tuple]],
    schema: str,
) -> DataFrame:
    """``step`` mutates the state of the current key and returns output rows; ``finish`` flushes a key."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != current:
                    if current is not None:
                        out.extend(finish(state, current))
                    current, state = key, start()
                out.extend(step(state, row))
            if out:
                yield pd.DataFrame(out, columns=names)
        if current is not None:
            rest = finish(state, current)
            if rest:
                yield pd.DataFrame(rest, columns=names)

    return df.repartition(tasks(df.sparkSession), *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
