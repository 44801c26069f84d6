"""The inputs of the registered streams: every batch in several files, none of which holds all its rows."""

import pytest
from compare import check, oracle
from pyspark.sql import functions as F

from veilspark.plans import streams


def test_a_batch_is_a_range_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100, raising=False)
    rows = spark.range(1000).select("id", (F.col("id") * 7 % 1000).alias("at"))
    seen = []

    def each(df, batch_id):
        seen.append(df.select("at", F.spark_partition_id().alias("p")).agg(F.min("at"), F.max("at"), F.count(F.lit(1)), F.count_distinct("p")).first())

    stream = streams.as_stream(spark, rows, 2, "at")
    stream.writeStream.foreachBatch(each).option("checkpointLocation", streams.scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 2 and sum(s[2] for s in seen) == 1000
    assert seen[0][1] < seen[1][0] and all(s[3] > 1 for s in seen)


@pytest.mark.parametrize("name", ["stream_session_ttl", "stream_first_seen"])
def test_oracle_over_several_files(name, spark, sf, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 40, raising=False)
    problem = check(name, streams.QUERIES[name], streams.SQL[name], spark, sf, oracle(sf))
    assert problem is None, problem
