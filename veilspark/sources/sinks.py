"""Tables written by the jobs.  Only the vault holds originals; every other sink has kinds and hashes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.text import short_hash


def request_log_rows(decided: DataFrame) -> DataFrame:
    """Log rows of decided requests ``(req_id, ts, host, path, session, body, hits, kinds, decision)``: no body text."""
    h = F.col("hits")
    rule_ids = F.array_distinct(F.filter(F.transform(h, lambda x: x["rule_id"]), lambda r: (r != "") & (r != "locker")))
    return decided.where("decision <> 'pass'").select(
        F.col("req_id").alias("id"),
        "ts",
        "host",
        "path",
        "session",
        "kinds",
        F.col("decision").alias("action"),
        short_hash(F.col("body")).alias("req_hash"),
        (F.col("decision") == "block").cast("int").alias("blocked"),
        F.lit("none").alias("user_label"),
        F.lit(None).cast("timestamp").alias("label_ts"),
        F.when(F.col("decision") == "passthrough", "").otherwise(F.array_join(rule_ids, ",")).alias("rule_id"),
        F.lit("").alias("rule_ver"),
    )


def write_request_log(rows: DataFrame, path: str, batch_id: str | int = 0) -> None:
    """Partitioned by day, so that retention and time filters prune folders, and by batch: a batch that is written again replaces itself."""
    _replace(rows.withColumn("dt", F.to_date("ts")).withColumn("batch_id", F.lit(str(batch_id))), path, "dt", "batch_id")


def _replace(df: DataFrame, path: str, *parts: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch into its own partition; a repeated batch replaces itself."""
    _replace(df.withColumn("batch_id", F.lit(batch_id)), path, "batch_id")


class AuditWriter:
    """``foreachBatch`` sink for audit events: drops rows older than the last clear.

    A batch that fails stops the stream, which repeats it when it starts again.  With ``strict=False`` failed batches are counted in
    ``failed``, named in ``lost`` and left out.
    """

    def __init__(self, path: str, cutoff: Column | None = None, strict: bool = True):
        self.path, self.cutoff, self.strict, self.failed, self.lost = path, cutoff, strict, 0, []

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        rows = df if self.cutoff is None else df.where(F.col("ts") >= self.cutoff)
        try:
            write_batch(rows, self.path, batch_id)
        except Exception:
            self.failed += 1
            self.lost.append(batch_id)
            if self.strict:
                raise


#: Folders of a vault by session: a reader of some sessions opens only theirs.
VAULT_BUCKETS = 64


def vault_bucket(session: Column | str = "session") -> Column:
    return F.pmod(F.xxhash64(session), F.lit(VAULT_BUCKETS)).cast("int")


def write_vault(vault: DataFrame, path: str, key: Column | None = None, batch_id: int = 0) -> None:
    """The restricted vault table by session bucket and batch; a batch that is written again replaces itself.

    ``key`` (16, 24 or 32 bytes) encrypts originals.
    """
    if key is not None:
        vault = vault.withColumn("original", F.base64(F.aes_encrypt(F.col("original"), key)))
    _replace(vault.withColumn("bucket", vault_bucket()).withColumn("batch_id", F.lit(batch_id)), path, "bucket", "batch_id")


def read_vault(spark: SparkSession, path: str, key: Column | None = None, sessions: DataFrame | None = None, before: int | None = None, schema: str | None = None) -> DataFrame:
    """The vault, or the rows of ``sessions (session)``, for which only their buckets are opened; ``before`` leaves later batches out.

    With ``schema`` a vault that isn't written yet is empty.
    """
    try:
        df = (spark.read if schema is None else spark.read.schema(f"{schema}, bucket INT, batch_id INT")).parquet(path)
    except AnalysisException as e:
        if schema is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        df = df.where(F.col("batch_id") < before)
    if sessions is not None:
        # At most as many numbers as there are buckets.
        wanted = [r.b for r in sessions.select(vault_bucket().alias("b")).distinct().collect()]
        df = df.where(F.col("bucket").isin(wanted)).join(sessions.select("session").distinct(), "session", "left_semi")
    df = df.drop("bucket", "batch_id")
    if key is not None:
        df = df.withColumn("original", F.aes_decrypt(F.unbase64("original"), key).cast("string"))
    return df


def compact_vault(spark: SparkSession, path: str, to: str) -> None:
    """Writes the vault to a new folder with one part for each bucket; equal rows become one.  The caller puts it in place."""
    rows = spark.read.parquet(path).drop("batch_id").distinct()
    _replace(rows.repartition("bucket").sortWithinPartitions("bucket", "session").withColumn("batch_id", F.lit(0)), to, "bucket", "batch_id")
