"""Probe scans: which steps are covered, five risk dimensions, one verdict per scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.text import safe_text, severity_rank


def valid_receipts(receipts: DataFrame) -> DataFrame:
    """A reply below 400 is a receipt; the error step accepts any status of a sent probe."""
    ok = F.when(F.col("step") == "step9_error", F.col("status") > 0).otherwise(
        (F.col("status") > 0) & (F.col("status") < 400)
    )
    return receipts.withColumn("valid", F.coalesce(ok, F.lit(False)))


def step_findings(plan: DataFrame, receipts: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of every planned probe.  A covered step without findings keeps one row with NULLs."""
    ok = valid_receipts(plan.join(receipts, ["scan_id", "probe_id"], "left")).withColumnRenamed("valid", "covered")
    return ok.select("scan_id", "step", "probe_id", "covered").join(findings, ["scan_id", "probe_id"], "left").select(
        "scan_id",
        "step",
        "probe_id",
        "covered",
        F.when(F.col("covered"), F.col("signal")).alias("signal"),
        F.when(F.col("covered"), F.col("severity")).alias("severity"),
        F.when(F.col("covered"), F.col("evidence")).alias("evidence"),
    )


def risk_matrix(steps: DataFrame) -> DataFrame:
    """One row per scan: five dimensions, coverage and the verdict.

    ``<dim>`` is a hit, ``<dim>_ok`` a covered step without one.
    """
    rank = severity_rank(F.col("severity"), 1)
    has = F.col("severity").isNotNull()

    # First by step, so that distinct steps are rows to count: no row is copied, and the second pass meets few rows a scan.
    s = steps.groupBy("scan_id", "step").agg(
        F.coalesce(F.bool_or("covered"), F.lit(False)).alias("done"),
        F.max(F.when(F.col("covered") & has, rank)).alias("top"),
        F.coalesce(F.bool_or(F.col("covered") & has & (rank == 2)), F.lit(False)).alias("medium"),
        F.coalesce(F.bool_or(F.col("covered") & has & (F.col("signal") == "cross_request_pollution")), F.lit(False)).alias("echoed"),
        F.max(F.when(F.col("covered") & has & (F.col("signal") == "tool_call_rewrite"), rank)).alias("rewrite"),
        F.max(F.when(F.col("covered") & has & (F.col("signal") == "sse_anomaly"), rank)).alias("anomaly"),
    )

    def at(step: str, cond: Column) -> Column:
        return F.coalesce(F.bool_or((F.col("step") == step) & F.coalesce(cond, F.lit(False))), F.lit(False))

    def covered(step: str) -> Column:
        return at(step, F.col("done"))

    m = s.groupBy("scan_id").agg(
        at("step3_verify", F.col("echoed")).alias("echo"),
        covered("step3_verify").alias("c_echo"),
        at("step8_toolcall", F.col("rewrite") >= 2).alias("replay"),
        covered("step8_toolcall").alias("c_replay"),
        at("step9_error", F.col("top") >= 3).alias("leak"),
        at("step9_error", F.col("medium")).alias("some_leak"),
        covered("step9_error").alias("c_leak"),
        at("step10_stream", F.col("anomaly") >= 2).alias("flow"),
        covered("step10_stream").alias("c_flow"),
        at("step11_web3", F.col("top") >= 2).alias("induce"),
        covered("step11_web3").alias("c_induce"),
        F.coalesce(F.max("top"), F.lit(1)).alias("worst"),
        F.count("step").alias("expected"),
        F.count(F.when(F.col("done"), F.col("step"))).alias("n_covered"),
    )
    m = m.withColumn("leak_mid", ~F.col("leak") & F.col("some_leak")).withColumn(
        "incomplete", F.col("n_covered") < F.col("expected")
    )
    return m.select(
        "scan_id",
        "echo",
        (F.col("c_echo") & ~F.col("echo")).alias("echo_ok"),
        "replay",
        (F.col("c_replay") & ~F.col("replay")).alias("replay_ok"),
        "leak",
        "leak_mid",
        (F.col("c_leak") & ~F.col("leak") & ~F.col("leak_mid")).alias("leak_ok"),
        "flow",
        (F.col("c_flow") & ~F.col("flow")).alias("flow_ok"),
        "induce",
        (F.col("c_induce") & ~F.col("induce")).alias("induce_ok"),
        "worst",
        F.concat_ws("/", F.col("n_covered").cast("string"), F.col("expected").cast("string")).alias("coverage"),
        "incomplete",
    )


def risk_verdict(matrix: DataFrame) -> DataFrame:
    """The single conclusion: critical first, then incomplete coverage, then the dimensions, never below the worst."""
    base = (
        F.when(F.col("worst") == 4, 4)
        .when(F.col("replay") | F.col("leak") | F.col("flow") | F.col("induce") | F.col("echo"), 3)
        .when(F.col("leak_mid") | (F.col("worst") >= 2), 2)
        .otherwise(1)
    )
    final = F.greatest(base, F.col("worst"))
    name = F.element_at(F.array(*[F.lit(s) for s in fx.SEVERITIES]), final)
    return matrix.withColumn(
        "severity", F.when(F.col("incomplete") & (F.col("worst") < 4), "INCONCLUSIVE").otherwise(name)
    )


def report_rows(steps: DataFrame) -> DataFrame:
    """Report lines with cleaned, shortened text that is safe inside a table cell."""
    ev = safe_text(F.col("evidence"), fx.REPORT_EVIDENCE_CHARS)
    return steps.where("covered AND severity IS NOT NULL").select(
        "scan_id",
        "step",
        "severity",
        safe_text(F.col("signal"), fx.REPORT_SIGNAL_CHARS).alias("signal"),
        F.replace(F.replace(ev, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")).alias("evidence"),
    )
