"""Streams with expiring state: the same result however the stream is cut, and no state of dead keys."""

import datetime as d
import uuid

import pytest

from pyspark.sql import functions as F
from veilspark.streaming import expiring

T0 = d.datetime(2024, 1, 1)


def at(seconds):
    return T0 + d.timedelta(seconds=seconds)


def run(spark, tmp_path, rows, schema, cuts, job):
    """Writes rows as files cut at ``cuts`` seconds, runs the job over them one by one; result rows and the store's last row count."""
    path = str(tmp_path / uuid.uuid4().hex)
    df = spark.createDataFrame(rows, schema)
    for low, high in zip([-1e9, *cuts], [*cuts, 1e9]):
        df.where((F.col("ts") >= at(low)) & (F.col("ts") < at(high))).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("ts", "0 seconds")
    q = job(stream).writeStream.format("parquet").option("checkpointLocation", path + "-cp").trigger(availableNow=True).start(path + "-out")
    q.awaitTermination()
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress and q.lastProgress["stateOperators"] else None
    return sorted(tuple(r) for r in spark.read.parquet(path + "-out").collect()), kept


@pytest.mark.parametrize("cuts", [[], [50, 120], [10, 11, 130, 300, 900]])
def test_sessions_end_at_their_own_time(spark, tmp_path, cuts):
    rows = [("a", at(0), "touch"), ("a", at(40), "touch"), ("a", at(200), "touch"), ("b", at(0), "pin"), ("b", at(10), "touch"), ("b", at(290), "touch"),
            ("c", at(5), "unpin"), ("d", at(0), "pin"), ("d", at(60), "unpin"), ("z", at(1000), "touch")]
    got, _ = run(spark, tmp_path, rows, "session string, ts timestamp, kind string", cuts, lambda s: expiring.session_ends(s, 100, 300))
    zero = T0.replace(tzinfo=d.timezone.utc).timestamp()
    assert [(s, round(t - zero)) for s, t in got] == [("a", 40), ("a", 200), ("b", 290), ("d", 0)]


@pytest.mark.parametrize("cuts", [[], [15, 100]])
def test_replies_meet_recent_requests(spark, tmp_path, cuts):
    rows = [("c", at(0), False, 1), ("c", at(10), True, 2), ("c", at(20), False, 3), ("c", at(200), True, 4), ("c", at(201), False, 5), ("c", at(202), True, 6), ("x", at(0), True, 7), ("w", at(5000), True, 8)]
    got, _ = run(spark, tmp_path, rows, "client string, ts timestamp, is_reply boolean, id bigint", cuts, lambda s: expiring.latest_requests(s, 100))
    assert got == [("c", 2, 1), ("c", 4, -1), ("c", 6, 5), ("w", 8, -1), ("x", 7, -1)]


def test_waiting_uses_expire_and_leave_the_store(spark, tmp_path):
    rows = [("c", at(i), False, f"p{i}", "k") for i in range(17)] + [("c", at(20), True, None, None)] + [(f"dead{i}", at(i), False, "p", "k") for i in range(30)] + [("c", at(30), False, "late", "k"), ("c", at(500), True, None, None), ("z", at(5000), True, None, None)]
    got, kept = run(spark, tmp_path, rows, "client string, ts timestamp, is_reply boolean, path string, entry string", [25, 600], lambda s: expiring.settled_uses(s, 100))
    assert sorted(p for c, _, p, _ in got if c == "c") == sorted(f"p{i}" for i in range(17)) and {c for c, *_ in got} == {"c"}
    assert kept is not None and kept < 5
