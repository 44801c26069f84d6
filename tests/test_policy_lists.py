"""Policy lists searched in the row and joined give the same; lists and bodies past former limits."""

import datetime as d
import random

import pytest

from pyspark.sql import functions as F
from veilspark.operators import logs as lg
from veilspark.operators import policy as pl
from veilspark.operators.locker import LockerEntry


def requests(spark):
    rng = random.Random(8)
    hosts = ["a.example.org", "b.a.example.org:443", "example.org", "notexample.org", "x.net", "", None, "Deep.B.A.example.ORG"]
    exes = ["C:\\Tools\\agent.exe", "c:\\tools\\sub\\x.exe", "/usr/bin/run", "run", "d:/work/ide", "", None]
    return spark.createDataFrame([(i, rng.choice(hosts), rng.choice(exes)) for i in range(200)], "req_id int, host string, exe string")


def entries(spark, rng):
    pats = {"domain": ["example.org", " A.example.org ", "x.net", "", "org", "b.a.example.org"], "process": ["c:\\tools\\", "agent.exe", "/usr/", "run", "d:/work", " "]}
    rows = [(i, k, rng.choice(pats[k]), rng.choice(["block", "mask"]), rng.random() < 0.3) for i in range(rng.choice([0, 1, 5, 9])) for k in [rng.choice(["domain", "process"])]]
    return spark.createDataFrame(rows, "pos int, kind string, pattern string, action string, scrub boolean")


@pytest.mark.parametrize("seed", range(4))
def test_both_ways_agree(spark, seed):
    reqs, rng = requests(spark), random.Random(seed)
    table = entries(spark, rng)
    for matched in (False, True):
        block = [{(r.req_id, r.block_action) for r in pl.blocklist_match(reqs, table, matched, in_row=n).collect()} for n in (100, -1)]
        allow = [{(r.req_id, r.allowed, r.allow_scrub) for r in pl.allowlist_match(reqs, table, matched, in_row=n).collect()} for n in (100, -1)]
        assert block[0] == block[1] and allow[0] == allow[1] and len(block[0]) == 200


def test_requests_do_not_move(spark):
    reqs, table = requests(spark), entries(spark, random.Random(3))
    out = pl.allowlist_match(pl.blocklist_match(reqs, table), table)
    plan = out._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Join" not in main and "hashpartitioning(host" not in plan and "hashpartitioning(exe" not in plan


def test_a_long_list_is_searched_by_halves(spark):
    table = spark.range(5000).select(F.col("id").cast("int").alias("pos"), F.lit("domain").alias("kind"), F.concat(F.lit("h"), "id", F.lit(".org")).alias("pattern"), F.lit("mask").alias("action"))
    reqs = spark.createDataFrame([(1, "www.h4999.org", ""), (2, "h0.org", ""), (3, "h5000.org", "")], "req_id int, host string, exe string")
    assert {r.req_id: r.block_action for r in pl.blocklist_match(reqs, table).collect()} == {1: "mask", 2: "mask", 3: None}


def test_no_limit_on_hosts_markers_pages_and_bodies(spark):
    hosts = spark.range(70).select(F.col("id").alias("pos"), F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"))
    assert pl.clean_hosts(hosts)[0].count() == 70 and pl.clean_hosts(hosts, 64)[0].count() == 64
    now = d.datetime(2024, 1, 1)
    reg = spark.range(501).select(F.concat(F.lit("n"), "id").alias("nonce"), F.lit(now).alias("ts"))
    assert lg.markers_active(reg, F.lit(now)).count() == 501 and lg.markers_active(reg, F.lit(now), 500).count() == 500
    log = spark.range(150).select("id", F.lit("mask").alias("action"), F.lit(now).alias("ts"))
    assert lg.requests_page(log, 0, 120)[0].count() == 120 and lg.requests_page(log, 0, 120, most=100)[0].count() == 100
    assert lg.requests_after(log, None, 120).count() == 120
    events = spark.range(1200).select(F.col("id") + 1, F.lit("HIGH").alias("severity"), F.lit("x").alias("signal_type")).toDF("id", "severity", "signal_type")
    assert lg.audit_since(events, 0, 1100).count() == 1100
    big = spark.createDataFrame([(1, "x" * (2 << 20) + " s3cret-value", "passthrough", True, False)], "req_id int, body string, decision string, allowed boolean, allow_scrub boolean")
    assert [r.entry for r in pl.passthrough_credentials(big, [LockerEntry("k", "s3cret-value")], ["req_id"]).collect()] == ["k"]
    table = spark.createDataFrame([(0, "k", "s3cret-value", "mask", True, "value")], "pos bigint, name string, value string, action string, enabled boolean, kind string")
    assert [r.entry for r in pl.passthrough_credentials(big, table, ["req_id"]).collect()] == ["k"]


def test_requests_of_one_file_are_decided_on_all_cores(spark, sf):
    from veilspark.plans import scalars

    assert scalars.blocked(spark, sf).select("req_id").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
