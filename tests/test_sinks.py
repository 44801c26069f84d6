"""Sinks that are written again, vaults read by session, messages read from files."""

import datetime as d

import pytest

from pyspark.sql import functions as F
from veilspark.sources import messages, sinks

VAULT = "session string, original string, tag string, placeholder string, suffix string, remapped boolean, created_ts timestamp"


def book(spark, n, start=0):
    return spark.range(start, start + n).select(
        F.concat(F.lit("s"), F.col("id") % 40).alias("session"), F.concat(F.lit("value "), "id").alias("original"), F.lit("NAME").alias("tag"),
        F.concat(F.lit("[[PII:NAME:"), "id", F.lit("]]")).alias("placeholder"), F.col("id").cast("string").alias("suffix"), F.lit(False).alias("remapped"), F.lit(d.datetime(2024, 1, 1)).alias("created_ts"))


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(50).select("id", F.timestamp_seconds(F.col("id") * 40_000).alias("ts"), F.lit("mask").alias("action"))
    for batch in (1, 2, 2, 1):
        sinks.write_request_log(rows, path, batch)
    assert spark.read.parquet(path).count() == 100
    sinks.write_batch(rows, str(tmp_path / "b"), 3)
    sinks.write_batch(rows.limit(5), str(tmp_path / "b"), 3)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 5


def test_vault_is_read_by_session(spark, tmp_path):
    path, key = str(tmp_path / "v"), F.lit("0123456789abcdef").cast("binary")
    assert sinks.read_vault(spark, path, schema=VAULT).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sinks.read_vault(spark, path)
    for _ in range(2):
        sinks.write_vault(book(spark, 100), path, key, 0)
        sinks.write_vault(book(spark, 100, 100), path, key, 1)
    assert sinks.read_vault(spark, path, key).count() == 200 and sinks.read_vault(spark, path, key, before=1).count() == 100
    assert "value" not in spark.read.parquet(path).first().original
    some = spark.createDataFrame([("s3",), ("s3",), ("none",)], "session string")
    mine = sinks.read_vault(spark, path, key, sessions=some)
    assert {r.original for r in mine.collect()} == {f"value {i}" for i in (3, 43, 83, 123, 163)}
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    sinks.compact_vault(spark, path, str(tmp_path / "w"))
    assert sinks.read_vault(spark, str(tmp_path / "w"), key).exceptAll(sinks.read_vault(spark, path, key)).count() == 0
    assert sinks.read_vault(spark, str(tmp_path / "w"), key).count() == 200 and len(spark.read.parquet(str(tmp_path / "w")).inputFiles()) < len(spark.read.parquet(path).inputFiles())


def test_a_failed_batch_is_not_swallowed(spark, tmp_path):
    bad = spark.range(3).select("id", F.expr("raise_error('broken')").cast("string").alias("x"), F.lit(d.datetime(2024, 1, 1)).alias("ts"))
    writer = sinks.AuditWriter(str(tmp_path / "a"))
    with pytest.raises(Exception, match="broken"):
        writer(bad, 0)
    lenient = sinks.AuditWriter(str(tmp_path / "a"), strict=False)
    lenient(bad, 4)
    assert (lenient.failed, lenient.lost) == (1, [4])


def test_messages_from_files(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([(1, "a", d.datetime(2024, 1, 1, 5), "tëxt"), (2, None, None, None)], "msg_id bigint, session string, ts timestamp_ntz, body string").write.parquet(path)
    rows = messages.read_messages(spark, path, schema="msg_id BIGINT, session STRING, ts TIMESTAMP_NTZ, body STRING, host STRING")
    assert dict(rows.dtypes)["ts"] == "timestamp" and sorted((r.msg_id, r.body, r.host) for r in rows.collect()) == [(1, "tëxt", None), (2, None, None)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("one\ntwo\n")
    assert [r.value for r in messages.read_messages(spark, str(tmp_path / "t"), "text").collect()] == ["one", "two"]
    assert messages.read_messages(spark, path, schema="msg_id BIGINT, session STRING, ts TIMESTAMP, body STRING", stream=True).isStreaming
    gate = spark.createDataFrame([("application/json; charset=utf-8",), ("text/html",)], "ct string").select(messages.json_gate(F.col("ct"))).collect()
    assert [r[0] for r in gate] == [True, False]
