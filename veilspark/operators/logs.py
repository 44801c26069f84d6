"""Reports and maintenance on the request log and the audit event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.text import host_from_session, severity_rank
from veilspark.operators.anchored import counted, notices
from veilspark.sources.lineage import cut


def log_stats(log: DataFrame) -> DataFrame:
    """Total, masked and blocked requests and the number of sessions."""
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("action") == "mask").alias("masked"),
        F.count_if(F.col("blocked") == 1).alias("blocked"),
        F.count_distinct("session").alias("sessions"),
    )


def newest(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The newest n rows, newest first (a top-k, not a sort)."""
    return df.orderBy(F.desc(order)).limit(n)


def recent_requests(log: DataFrame, n: int) -> DataFrame:
    return newest(log, n)


def _action_filter(action: str | None) -> Column:
    if action == "mask":
        return F.col("action") == "mask"
    if action == "block":
        return (F.col("blocked") == 1) | (F.col("action") == "block")
    return F.lit(True)


def requests_filtered(log: DataFrame, action=None, from_ts=None, to_ts=None) -> DataFrame:
    df = log.where(_action_filter(action))
    if from_ts is not None:
        df = df.where(F.col("ts") >= F.lit(from_ts).cast("timestamp"))
    if to_ts is not None:
        df = df.where(F.col("ts") < F.lit(to_ts).cast("timestamp"))
    return df


def _page(limit: int, most: int | None) -> int:
    return max(limit, 1) if most is None else min(max(limit, 1), most)


def requests_page(log: DataFrame, offset: int, limit: int, action=None, from_ts=None, to_ts=None, most: int | None = None):
    """One page of ``limit`` rows, newest first, and a one-row frame with the filtered total; ``most`` bounds the page.

    ``offset`` reads everything before the page; ``requests_after`` pages by key instead.
    """
    df = requests_filtered(log, action, from_ts, to_ts)
    page = df.orderBy(F.desc("id")).offset(max(offset, 0)).limit(_page(limit, most))
    return page, df.agg(F.count(F.lit(1)).alias("total"))


def requests_after(log: DataFrame, last_id: int | None, limit: int, action=None, from_ts=None, to_ts=None, most: int | None = None) -> DataFrame:
    """The page of rows older than ``last_id``: a filtered top-k whatever the depth."""
    df = requests_filtered(log, action, from_ts, to_ts)
    if last_id is not None:
        df = df.where(F.col("id") < last_id)
    return newest(df, _page(limit, most))


def audit_since(events: DataFrame, since: int, limit: int, floor: str | None = None, signal: str | None = None, most: int | None = None) -> DataFrame:
    """The newest ``limit`` rows after ``since`` that pass the filters, oldest first; ``most`` bounds their number."""
    df = events.where(F.col("id") > since)
    rank = {s: i + 1 for i, s in enumerate(fx.SEVERITIES)}.get((floor or "").strip().upper(), 0)
    if rank:
        row_rank = F.when(F.col("severity") == "CRITICAL", 4).when(F.col("severity") == "HIGH", 3).when(
            F.col("severity") == "MEDIUM", 2).otherwise(1)
        df = df.where(row_rank >= rank)
    if signal and signal.strip():
        df = df.where(F.col("signal_type") == signal)
    return newest(df, _page(limit, most)).orderBy("id")


def audit_recent(events: DataFrame, limit: int) -> DataFrame:
    return newest(events, limit)


def recent_events_ring(events: DataFrame) -> DataFrame:
    return newest(events, fx.RECENT_EVENTS)


def signal_counts(events: DataFrame, enabled: dict[str, bool] | None = None) -> DataFrame:
    """Count per catalogue signal, zeros included, with the enabled and implemented flags."""
    on = {name: impl for name, impl in fx.SIGNALS} | (enabled or {})
    catalogue = events.sparkSession.createDataFrame(
        [(i, n, on[n], impl) for i, (n, impl) in enumerate(fx.SIGNALS)],
        "pos int, signal string, enabled boolean, implemented boolean",
    )
    counts = events.groupBy(F.col("signal_type").alias("signal")).agg(F.count(F.lit(1)).alias("hits"))
    return catalogue.join(counts, "signal", "left").select(
        "pos", "signal", "enabled", "implemented", F.coalesce("hits", F.lit(0)).alias("hits")
    )


def expired(now: Column, days: dict[str, int] | None = None) -> Column:
    """True for log rows past the retention of their action; zero or fewer days keep for ever."""
    out = F.lit(False)
    for action, d in (days or fx.RETENTION_DAYS).items():
        if d > 0:
            out = out | ((F.col("action") == action) & (F.col("ts") < now - F.expr(f"INTERVAL {d} DAYS")))
    return out


def retention_split(log: DataFrame, events: DataFrame, now: Column, days=None, audit_days: int = fx.AUDIT_RETENTION_DAYS):
    """Kept log rows, kept audit rows, and removed counts per action (``total`` leaves audit out)."""
    gone = expired(now, days)
    old_event = F.col("ts") < now - F.expr(f"INTERVAL {audit_days} DAYS") if audit_days > 0 else F.lit(False)
    actions = list((days or fx.RETENTION_DAYS))
    per = log.agg(*[F.count_if(gone & (F.col("action") == a)).alias(a) for a in actions])
    audit = events.agg(F.count_if(old_event).alias("audit"))
    rows = [F.struct(F.lit(a).alias("part"), F.col(a).alias("removed")) for a in actions]
    total = F.struct(F.lit("total").alias("part"), sum((F.col(a) for a in actions), F.lit(0)).alias("removed"))
    counts = per.select(F.inline(F.array(*rows, total))).unionByName(
        audit.select(F.lit("audit").alias("part"), F.col("audit").alias("removed"))
    )
    return log.where(~gone), events.where(~old_event), counts


def clear_by_action(log: DataFrame, action: str) -> DataFrame:
    """The log without the rows of one action; ``block`` also covers ``blocked = 1``."""
    drop = _action_filter("block") if action == "block" else F.col("action") == action
    return log.where(~drop)


def apply_labels(rows: DataFrame, feed: DataFrame):
    """Set the newest valid label per id from a feed ``(id, label, ts)``.

    Returns the labelled rows and the rejected feed rows with a reason.
    """
    f = feed.withColumn("label", F.trim("label"))
    ok = f.where(F.col("label").isin("fp", "tn", "none"))
    bad = f.where(~F.col("label").isin("fp", "tn", "none")).withColumn("reason", F.lit("bad_label"))
    last = ok.groupBy("id").agg(F.max_by("label", "ts").alias("new_label"), F.max("ts").alias("new_ts"))
    out = (
        rows.join(last, "id", "left")
        .withColumn("user_label", F.coalesce("new_label", "user_label"))
        .withColumn("label_ts", F.coalesce("new_ts", "label_ts"))
        .drop("new_label", "new_ts")
    )
    unknown = ok.join(rows.select("id"), "id", "left_anti").withColumn("reason", F.lit("unknown_id"))
    return out, bad.unionByName(unknown)


def _fp_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("hits"),
        F.count_if(F.col("user_label") == "fp").alias("fp"),
        F.count_if(F.col("user_label") == "tn").alias("tn"),
    ]


def _in_window(now: Column) -> Column:
    return F.col("ts") >= now - F.expr(f"INTERVAL {fx.FEEDBACK_WINDOW_SECONDS} SECONDS")


def fp_stats_signal(events: DataFrame, now: Column) -> DataFrame:
    """Hits and feedback per signal in the last 30 days."""
    return events.where(_in_window(now)).groupBy(F.col("signal_type").alias("key")).agg(*_fp_counts()).orderBy(
        F.desc("hits"), "key"
    )


def fp_stats_rule(log: DataFrame, now: Column) -> DataFrame:
    """Hits and feedback per rule id; a row counts once for each rule in its comma list."""
    return (
        log.where(_in_window(now) & (F.col("rule_id") != ""))
        .select("user_label", F.explode(F.split("rule_id", ",")).alias("key"))
        .withColumn("key", F.trim("key"))
        .where("key <> ''")
        .groupBy("key")
        .agg(*_fp_counts())
        .orderBy(F.desc("hits"), "key")
    )


def noise_ratio(events: DataFrame) -> DataFrame:
    """Events per hour and signal."""
    return (
        events.groupBy(F.window("ts", "1 hour").alias("w"), "signal_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("hour"), "signal_type", "events")
    )


def active_sessions(meta: DataFrame, vault: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions seen recently or holding placeholders.

    ``meta(session, host, process, last_seen)``, ``vault(session, …)``,
    ``sessions(session, last_touch, pinned_at)``.  The vault touch wins over the request time.
    """
    recent = (
        meta.groupBy("session")
        .agg(
            F.max_by("host", "last_seen").alias("host"),
            F.max_by("process", "last_seen").alias("process"),
            F.max("last_seen").alias("last_seen"),
        )
        .where(F.unix_timestamp(now) - F.unix_timestamp("last_seen") < fx.SESSION_IDLE_SECONDS)
    )
    held = vault.groupBy("session").agg(F.count(F.lit(1)).alias("placeholders"))
    joined = recent.join(held, "session", "full").join(sessions, "session", "left")
    idle = F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("last_touch", "last_seen"))
    pinned = F.unix_timestamp(now) - F.unix_timestamp("pinned_at") < fx.PIN_HARD_LIMIT_SECONDS
    return joined.select(
        "session",
        F.coalesce(F.nullif(F.col("host"), F.lit("")), host_from_session(F.col("session"))).alias("host"),
        F.coalesce("process", F.lit("")).alias("process"),
        F.coalesce("placeholders", F.lit(0)).alias("placeholders"),
        F.coalesce(idle, F.lit(0)).alias("idle_secs"),
        F.coalesce(pinned, F.lit(False)).alias("pinned"),
    ).orderBy("idle_secs", "session")


def expired_sessions(sessions: DataFrame, now: Column, ttl: int = fx.SESSION_IDLE_SECONDS) -> DataFrame:
    """Sessions idle beyond the limit, unless pinned within the hard limit."""
    held = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("pinned_at") < fx.PIN_HARD_LIMIT_SECONDS, F.lit(False))
    return sessions.where((F.unix_timestamp(now) - F.unix_timestamp("last_touch") > ttl) & ~held)


def first_seen_clients(requests: DataFrame) -> DataFrame:
    return requests.where(F.trim("exe") != "").groupBy("exe").agg(F.min("ts").alias("first_ts"))


def kind_feed(decided: DataFrame) -> DataFrame:
    """One event per detected kind of a decided request; works on batch and stream."""
    return decided.select(
        "session", F.explode("kinds").alias("kind"), "host", F.col("decision").alias("action"), "ts"
    )


def posture_summary(log: DataFrame, events: DataFrame, vault: DataFrame, now: Column) -> DataFrame:
    """Placeholders held, signal hits, enabled and pending signals, days in use."""
    a = log.agg(F.min("ts").alias("first_ts")).select(
        (F.datediff(now, F.col("first_ts")) + 1).alias("days"), F.lit(1).alias("k")
    )
    b = vault.agg(F.count(F.lit(1)).alias("placeholders")).withColumn("k", F.lit(1))
    c = events.agg(F.count(F.lit(1)).alias("signal_hits")).withColumn("k", F.lit(1))
    on = sum(1 for _, impl in fx.SIGNALS if impl)
    return (
        a.join(b, "k").join(c, "k")
        .select(
            "placeholders", "signal_hits", F.lit(on).alias("enabled_signals"),
            F.lit(len(fx.SIGNALS) - on).alias("pending_signals"), "days",
        )
    )


def markers_active(registrations: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """Marker registry: newest time per nonce, alive within the time limit; with ``most`` only that many of the newest."""
    alive = (
        registrations.withColumn("nonce", F.trim("nonce"))
        .where("nonce <> ''")
        .groupBy("nonce")
        .agg(F.max("ts").alias("ts"))
        .where(F.unix_timestamp(now) - F.unix_timestamp("ts") < fx.MARKER_TTL_SECONDS)
    )
    return alive if most is None else alive.orderBy(F.desc("ts"), F.desc("nonce")).limit(most)


def severity_floor(df: DataFrame, floor: str = "MEDIUM") -> DataFrame:
    return df.where(severity_rank(F.col("severity"), 1) >= {s: i + 1 for i, s in enumerate(fx.SEVERITIES)}.get(floor.upper(), 2))


def usage_cooldown(uses: DataFrame, cooldown: float = fx.USAGE_COOLDOWN_SECONDS) -> DataFrame:
    """Notices per (path, entry): the first use notifies, later ones once per cooldown after the last notice.

    This is an anchored cooldown, not a session window.  Equal times are counted together first.
    """
    per = uses.groupBy("path", "entry", F.unix_micros("ts").alias("us")).agg(F.count(F.lit(1)).alias("n"))
    found = notices(per, ["path", "entry"], int(cooldown * 1_000_000))
    return found.select(
        "path", "entry", "count", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("notice_us").alias("notice_ts")
    )


def usage_ledger(uses: DataFrame, responses: DataFrame) -> DataFrame:
    """Settle staged uses ``(client, path, entry, ts)`` at the next reply of the client.

    A reply ``(client, ts)`` takes the uses staged since the reply before it; uses older than the time
    limit are dropped, and a use without a later reply never settles.  One row per reply, path and entry.
    """
    marks = uses.select("client", "ts", F.lit(0).alias("is_reply"), "path", "entry").unionByName(
        responses.select("client", "ts", F.lit(1).alias("is_reply"), F.lit(None).cast("string").alias("path"),
                         F.lit(None).cast("string").alias("entry"))
    )
    # Newest first, so that "the next reply" is a running value and not a new search per row.
    seen = W.partitionBy("client").orderBy(F.desc("ts"), F.desc("is_reply")).rowsBetween(W.unboundedPreceding, W.currentRow)
    settled = marks.withColumn("reply_ts", F.last(F.when(F.col("is_reply") == 1, F.col("ts")), ignorenulls=True).over(seen))
    return (
        settled.where("is_reply = 0 AND reply_ts IS NOT NULL")
        .groupBy("client", "reply_ts", "path", "entry")
        .agg(F.min("ts").alias("entry_ts"))
        .withColumn("staged_ts", F.min("entry_ts").over(W.partitionBy("client", "reply_ts", "path")))
        .where(F.unix_micros("reply_ts") - F.unix_micros("staged_ts") <= fx.REQUEST_CONTEXT_SECONDS * 1_000_000)
        .select("client", "reply_ts", "path", "entry", "staged_ts")
    )


def alert_throttle(events: DataFrame, floor: str = "HIGH", gap: int = fx.ALERT_INTERVAL_SECONDS) -> DataFrame:
    """Alerts from event batches ``(batch, ts, severity, id)``.

    A batch whose highest severity reaches the floor raises one alert, unless the last one is too near.
    """
    rank = severity_rank(F.col("severity"))
    need = {s: i + 1 for i, s in enumerate(fx.SEVERITIES)}[floor]
    tops = (
        events.groupBy("batch")
        .agg(F.max("ts").alias("ts"), F.max(rank).alias("top"), F.count(F.lit(1)).alias("events"))
        .where(F.col("top") >= need)
        .select(F.unix_micros("ts").alias("us"), "batch", "top", "events")
    )
    tops = cut(tops)
    # Of batches at one time the first raises the alert.
    first = tops.groupBy("us").agg(F.min("batch").alias("batch"), F.min_by(F.struct("top", "events"), "batch").alias("b"))
    alerts = first.join(counted(tops.select("us"), [], gap * 1_000_000), "us")
    return alerts.select("batch", F.timestamp_micros("us").alias("ts"), F.col("b.top").alias("top"), F.col("b.events").alias("events"))


def request_for_response(responses: DataFrame, requests: DataFrame, limit: int = fx.REQUEST_CONTEXT_SECONDS) -> DataFrame:
    """As-of join: the latest request of the same client before each reply, within the time limit.

    ``requests``: ``client, ts, req_id``; ``responses``: ``client, ts, resp_id``.  Requests are matched
    inside time slots as long as the limit, so a busy client spreads over many tasks.
    """
    slot = (F.floor(F.unix_timestamp("ts") / limit)).cast("long")
    req = requests.select("client", F.col("ts").alias("req_ts"), "req_id", slot.alias("slot"))
    resp = responses.select("client", "ts", "resp_id", F.explode(F.array(slot, slot - 1)).alias("slot"))
    marks = resp.select("client", "slot", "ts", F.lit(1).alias("side"), "resp_id", F.lit(None).cast("timestamp").alias("req_ts"),
                        F.lit(None).cast(dict(requests.dtypes)["req_id"]).alias("req_id")).unionByName(
        req.select("client", "slot", F.col("req_ts").alias("ts"), F.lit(0).alias("side"),
                   F.lit(None).cast(dict(responses.dtypes)["resp_id"]).alias("resp_id"), "req_ts", "req_id")
    )
    before = W.partitionBy("client", "slot").orderBy("ts", "side", "req_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    latest = F.last(F.when(F.col("side") == 0, F.struct("req_ts", "req_id")), ignorenulls=True).over(before)
    found = marks.withColumn("r", latest).where("side = 1")
    best = found.groupBy("client", "resp_id").agg(F.min("ts").alias("ts"), F.max("r").alias("r"))
    fresh = F.unix_micros("ts") - F.unix_micros("r.req_ts") < limit * 1_000_000
    return best.select("client", "resp_id", "ts", F.when(fresh, F.col("r.req_id")).alias("req_id"))
