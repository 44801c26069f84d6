"""Reading message tables, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = (
    "msg_id BIGINT, session STRING, seq BIGINT, direction STRING, host STRING, path STRING, content_type STRING,"
    " status INT, ts TIMESTAMP, body STRING"
)


def read_messages(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str = MESSAGE_SCHEMA, stream: bool = False, **options
) -> DataFrame:
    """Messages from parquet, JSON or text files.  Times without a zone become TIMESTAMP."""
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
    df = (reader if fmt == "text" else reader.schema(schema)).load(path)
    for name, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(name, F.col(name).cast("timestamp"))
    return df


def json_gate(content_type: Column) -> Column:
    """Only JSON request bodies are scanned; everything else passes through."""
    return F.contains(content_type, F.lit("application/json"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute an input that has fewer scan partitions than the cluster has cores.

    Text work is costly per row, so one small file should not keep a single core busy.  Inputs with
    enough partitions stay as they are, without a shuffle.  Meant for scans: counting the partitions of a
    plan with joins would run part of it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(cores, *keys)
