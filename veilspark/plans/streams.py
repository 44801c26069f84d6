"""Registered queries: sinks and streaming jobs, run once over the given tables, with the batch oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilspark.operators import frames as fr
from veilspark.plans import reports as rp
from veilspark.plans import seeded as sd
from veilspark.plans import vaulting as va
from veilspark.plans.base import plain, us, view
from veilspark.plans.scalars import SQL as SCALAR_SQL
from veilspark.plans.scalars import decided
from veilspark.sources import messages, sinks
from veilspark.sources.lineage import checkpoint_dir
from veilspark.streaming import expiring, jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def scratch(spark) -> str:
    """A new folder under the checkpoint folder of the session."""
    return f"{checkpoint_dir(spark)}/veil-{uuid.uuid4().hex}"


#: Rows of a file of :func:`as_stream`.
FILE_ROWS = 25_000


def as_stream(spark, df, files: int = 2, by: str | None = None):
    """A table as a file stream of ``files`` micro-batches, written one after the other in the order of ``by``.

    All batches have the same number of files, which follows the rows of the smallest one, so no task writes or reads a whole batch.
    """
    raw, path = scratch(spark), scratch(spark)
    df.write.parquet(raw)
    rows = spark.read.schema(df.schema).parquet(raw)
    if by is None:
        width = max(1, rows.count() // files // FILE_ROWS)
        rows.repartition(files * width).write.parquet(path)
    else:
        at = F.col(by).cast("double")
        cuts = rows.agg(F.percentile_approx(at, [i / files for i in range(1, files)]).alias("c")).first()["c"] or []
        ranges = [F.lit(True) if low is None else at > low for low in [None, *cuts]]
        ranges = [r if high is None else r & (at <= high) for r, high in zip(ranges, [*cuts, None])]
        width = max(1, min(rows.agg(*(F.count_if(r) for r in ranges)).first()) // FILE_ROWS)
        for r in ranges:
            rows.where(r).repartition(width).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", width).parquet(path)


def run(df, spark):
    """Run a stream over everything available into files and read them back."""
    path = scratch(spark)
    q = df.writeStream.format("parquet").option("checkpointLocation", path + "-cp").trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def logged(s, sf):
    path = scratch(s)
    df = decided(s, sf).withColumn("path", F.lit("/v1")).withColumn("session", F.col("client"))
    rows = sinks.request_log_rows(df)
    # Written twice, as after a lost executor or a restart: the second time replaces the first.
    sinks.write_request_log(rows, path, 7)
    sinks.write_request_log(rows, path, 7)
    return s.read.parquet(path)


register(
    "sink_request_log",
    lambda s, sf: plain(logged(s, sf).select("id", "action", "req_hash", "blocked", F.array_join("kinds", ",").alias("kinds"))),
    "SELECT d.req_id AS id, d.decision AS action, substr(sha256(r.body), 1, 16) AS req_hash, CAST(d.decision = 'block' AS BIGINT) AS blocked, d.kinds FROM"
    f" ({SCALAR_SQL['decide']}) d JOIN ({sd.REQUESTS}) r ON r.req_id = d.req_id WHERE d.decision <> 'pass'",
)


def vaulted(s, sf):
    path, key = scratch(s), F.lit("0123456789abcdef").cast("binary")
    minted = va.minted(s, sf)
    sinks.write_vault(minted, path, key)
    sinks.write_vault(minted, path, key)
    return sinks.read_vault(s, path, key).select("session", "original", "tag", "placeholder", "suffix")


register("vault_sink", vaulted, va.SQL["vault_mint"])


def read_back(s, sf):
    """Messages written as JSON lines and read with their schema; columns that a file lacks are null."""
    path = scratch(s)
    view(s, sf, sd.MESSAGES, "msg_id").select("msg_id", "session", F.timestamp_seconds("seq").alias("ts"), "body", F.lit("more").alias("other")).write.json(path)
    rows = messages.read_messages(s, path, "json")
    return plain(rows.select("msg_id", "session", "ts", F.sha2("body", 256).alias("digest"), F.coalesce("host", F.lit("-")).alias("host")))


register(
    "read_messages",
    read_back,
    f"SELECT msg_id, session, CAST(seq AS BIGINT) * 1000000 AS ts, sha256(body) AS digest, '-' AS host FROM ({sd.MESSAGES})",
)


def audit_sink(s, sf):
    path = scratch(s)
    rows = view(s, sf, sd.AUDIT_EVENTS)
    jobs.stream_audit_sink(as_stream(s, rows), path, path + "-cp", F.expr("TIMESTAMP '2024-01-15 00:00:00'")).awaitTermination()
    return plain(s.read.parquet(path).select("id", "signal_type", "severity"))


register(
    "sink_audit_events",
    audit_sink,
    f"SELECT id, signal_type, severity FROM ({sd.AUDIT_EVENTS}) WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'",
)


def redacted(s, sf):
    vault, out = scratch(s), scratch(s)
    jobs.stream_redact(as_stream(s, va.messages(s, sf), 2, "seq"), vault, out, out + "-cp", va.SALT).awaitTermination()
    return s.read.parquet(out).select("msg_id", "session", "redacted")


register("stream_redact", redacted, va.SQL["redact_sessions"])


def restored(s, sf):
    """Pieces of many replies on a few channels per session; the last piece of a reply flushes its channel."""
    pieces = view(s, sf, va.PIECES)
    last = pieces.groupBy("msg_id").agg(F.max("seq").alias("last"))
    pieces = pieces.join(last, "msg_id").select(
        "session", (F.col("msg_id") % 8).alias("channel"), (F.col("msg_id") * 100 + F.col("seq")).alias("seq"), "text",
        (F.col("seq") == F.col("last")).alias("final"))
    out = scratch(s)
    jobs.stream_restore(as_stream(s, pieces, 2, "seq"), view(s, sf, sd.VAULT), ["session", "channel"], out, out + "-cp").awaitTermination()
    done = s.read.parquet(out).select("session", "channel", "piece", F.col("restored_text").alias("text"))
    return fr.channel_text(done, ["session", "channel"], ["piece"])


register(
    "stream_restore",
    restored,
    f"SELECT r.session, r.msg_id % 8 AS channel, string_agg(x.restored_text, '' ORDER BY r.msg_id) AS body FROM ({va.SQL['restore_pieces']}) x JOIN ({sd.REPLIES}) r USING (msg_id) GROUP BY 1, 2",
)


def cooled(s, sf):
    uses = view(s, sf, rp.USES).select("path", "entry", us("ts").alias("us"))
    return run(jobs.stream_usage_cooldown(as_stream(s, uses, 3, "us"), 7200), s)


register("stream_usage_cooldown", cooled, rp.SQL["usage_cooldown"])


def paired(s, sf):
    marks = view(s, sf, rp.REQ).select("client", "ts", F.lit(False).alias("is_reply"), F.col("req_id").alias("id")).unionByName(
        view(s, sf, rp.RESP).select("client", "ts", F.lit(True).alias("is_reply"), F.col("resp_id").alias("id")))
    return run(expiring.latest_requests(as_stream(s, marks, 3, "ts").withWatermark("ts", "0 seconds"), 14400), s)


register("stream_request_response", paired, rp.SQL["request_for_response"])


def settled(s, sf):
    marks = view(s, sf, rp.STAGED).withColumn("is_reply", F.lit(False)).unionByName(
        view(s, sf, rp.REPLIED).withColumn("is_reply", F.lit(True)), allowMissingColumns=True)
    return run(expiring.settled_uses(as_stream(s, marks, 3, "ts").withWatermark("ts", "0 seconds")), s)


register(
    "stream_usage_ledger", settled, f"SELECT client, reply_ts, path, entry FROM ({rp.SQL['usage_ledger']}) l"
)
register(
    "stream_first_seen",
    lambda s, sf: run(jobs.stream_first_seen(as_stream(s, view(s, sf, sd.REQUESTS), 3)), s),
    f"SELECT DISTINCT exe FROM ({sd.REQUESTS})",
)


ACTIVITY = "SELECT 'u' || CAST(user_id AS STRING) AS session, ts, event_id, CASE event_type WHEN 'error' THEN 'unpin' WHEN 'view' THEN 'pin' ELSE 'touch' END AS kind FROM events"
TTL, HARD = 2 * 3600, 3 * 3600


def purged(s, sf):
    """Sessions that ended by idling beyond two hours, or three hours after a pin."""
    act = view(s, sf, ACTIVITY).drop("event_id")
    out = expiring.session_ends(as_stream(s, act, 6, "ts").withWatermark("ts", "0 seconds"), TTL, HARD)
    return run(out, s).select("session", F.round(F.col("last_touch") * 1_000_000).cast("bigint").alias("last_touch"))


# State after each row of a session: last touch and pin; a row at or after the limit ends what was before it.
UNTIL = f"greatest(touch + {TTL}000000, coalesce(pin + {HARD}000000, 0))"
register(
    "stream_session_ttl",
    purged,
    f"""WITH RECURSIVE e AS (SELECT session, epoch_us(ts) AS us, kind, row_number() OVER (PARTITION BY session ORDER BY ts) AS rn FROM ({ACTIVITY})),
    w AS (
      SELECT session, rn, CASE WHEN kind <> 'unpin' THEN us END AS touch, CASE WHEN kind = 'pin' THEN us END AS pin, CAST(NULL AS BIGINT) AS ended FROM e WHERE rn = 1
      UNION ALL
      SELECT session, rn, CASE WHEN kind <> 'unpin' THEN us WHEN gone THEN NULL ELSE touch END, CASE WHEN kind = 'pin' THEN us WHEN kind = 'unpin' OR gone THEN NULL ELSE pin END, CASE WHEN gone THEN touch END
      FROM (SELECT e.session, e.rn, e.us, e.kind, w.touch, w.pin, w.touch IS NOT NULL AND {UNTIL} <= e.us AS gone FROM w JOIN e ON e.session = w.session AND e.rn = w.rn + 1)),
    n AS (SELECT session, max(rn) AS rn FROM e GROUP BY session)
    SELECT session, ended AS last_touch FROM w WHERE ended IS NOT NULL
    UNION ALL SELECT w.session, touch FROM w JOIN n ON n.session = w.session AND n.rn = w.rn WHERE touch IS NOT NULL AND {UNTIL} < (SELECT max(epoch_us(ts)) FROM events)""",
)


def markers(s, sf):
    path = scratch(s)
    reg = view(s, sf, rp.REGISTRATIONS)
    jobs.stream_markers(as_stream(s, reg, 4, "ts"), path, path + "-cp").awaitTermination()
    snap = s.read.parquet(path)
    newest = snap.agg(F.max("batch_id").alias("batch_id"))
    return plain(snap.join(newest, "batch_id").select("nonce", "ts"))


register(
    "stream_marker_registry",
    markers,
    f"SELECT trim(nonce) AS nonce, epoch_us(max(ts)) AS ts FROM ({rp.REGISTRATIONS}) WHERE trim(nonce) <> '' GROUP BY 1"
    " HAVING floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(max(ts))) < 3600",
)
