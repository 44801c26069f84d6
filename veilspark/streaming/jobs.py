"""Streaming jobs.  Each has a batch operator with the same result on the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.holdback import Cooldown, held_chars
from veilspark.operators import detect, logs, restore, vault
from veilspark.sources.sinks import AuditWriter, read_vault, write_batch, write_vault
from veilspark.streaming.keyed import keyed_columns, keyed_state


def _start(df: DataFrame, checkpoint: str, each, once: bool = True):
    w = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()


def _table(spark, path: str, schema: str, before: int) -> DataFrame:
    """Rows of earlier batches, so that a repeated batch does not see its own output."""
    full = schema + ", batch_id INT"
    try:
        return spark.read.schema(full).parquet(path).where(F.col("batch_id") < before).drop("batch_id")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


VAULT_SCHEMA = (
    "session STRING, original STRING, tag STRING, placeholder STRING, suffix STRING, remapped BOOLEAN, created_ts TIMESTAMP"
)


def stream_redact(messages: DataFrame, vault_path: str, out_path: str, checkpoint: str, salt: str, rules=None, once: bool = True):
    """Redact a message stream with placeholders that stay the same per session.

    A batch mints only pairs the vault does not hold, writes them to its own part of their buckets, then redacts with the rows of its
    own sessions, whose buckets alone are opened.  Placeholders are keyed hashes, so a repeated batch writes the same rows.
    """

    def each(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        # Each batch is a plain job: let it adapt, so that joins with the usually empty clash tables vanish.
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        scanned = detect.with_hits(df, rules).persist()
        hits = vault.session_hits(scanned)
        sessions = hits.select("session").distinct()
        mine = read_vault(spark, vault_path, sessions=sessions, before=batch_id, schema=VAULT_SCHEMA)
        write_vault(vault.mint_missing(hits, mine, salt), vault_path, batch_id=batch_id)
        now = read_vault(spark, vault_path, sessions=sessions, before=batch_id + 1, schema=VAULT_SCHEMA)
        out = vault.redact_with_vault(scanned, now, salt)
        write_batch(out.select("msg_id", "session", "redacted"), out_path, batch_id)
        scanned.unpersist()

    return _start(messages, checkpoint, each, once)


def realign_stream(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Hold back a partial placeholder per reply channel; a piece with ``final`` flushes the channel."""
    types = dict(pieces.dtypes)

    def fold(st: dict, rows: dict[str, list]) -> dict[str, list]:
        held, n = st.get("held", ""), st.get("n", 0)
        piece: list[int] = []
        out: list[str] = []
        for text, final in zip(rows["text"], rows["final"]):
            text = held + (text or "")
            keep = 0 if final else held_chars(text)
            held = text[len(text) - keep :] if keep else ""
            if keep < len(text):
                piece.append(n)
                out.append(text[: len(text) - keep] if keep else text)
            n += 1
        st["held"], st["n"] = held, n
        return {"piece": piece, "text": out, "overflowed": [False] * len(out)}

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", piece long, text string, overflowed boolean"
    return keyed_columns(pieces.select(*keys, "seq", "text", "final"), keys, "seq", fold, schema)


def stream_restore(pieces: DataFrame, vault_path_or_df, keys: list[str], out_path: str, checkpoint: str, once: bool = True):
    """Restore a stream of reply pieces ``(keys, seq, text, final)``; ``keys`` must hold ``session``."""
    cut = realign_stream(pieces, keys)

    def each(df: DataFrame, batch_id: int) -> None:
        v = vault_path_or_df
        if isinstance(v, str):
            v = read_vault(df.sparkSession, v, schema=VAULT_SCHEMA)
        # The restore reads its rows several times, and each time the state of all keys would be folded anew.
        rows = df.withColumnRenamed("text", "body").persist()
        done = restore.restore(rows, v, [*keys, "piece"])
        write_batch(done.select(*keys, "piece", "restored_text", "restored", "unresolved", "degraded", "overflowed"), out_path, batch_id)
        rows.unpersist()

    return _start(cut, checkpoint, each, once)


def stream_markers(registrations: DataFrame, path: str, checkpoint: str, once: bool = True):
    """The marker registry as one small snapshot per batch: newest time per nonce, expired and excess ones gone."""

    def each(df: DataFrame, batch_id: int) -> None:
        past = _table(df.sparkSession, path, "nonce STRING, ts TIMESTAMP", batch_id)
        last = df.sparkSession.read.parquet(path).where(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0] if batch_id and past.head(1) else None
        if last is not None:
            past = df.sparkSession.read.parquet(f"{path}/batch_id={last}")
        both = past.select("nonce", "ts").unionByName(df.select("nonce", "ts"))
        newest = both.agg(F.max("ts").alias("now")).first()["now"]
        if newest is not None:
            write_batch(logs.markers_active(both, F.lit(newest)), path, batch_id)

    return _start(registrations, checkpoint, each, once)


def stream_usage_cooldown(uses: DataFrame, cooldown: float = fx.USAGE_COOLDOWN_SECONDS) -> DataFrame:
    """Notices of credential use as in ``logs.usage_cooldown``, on a stream ``(path, entry, us)``."""

    def step(st: dict, row: dict) -> list[tuple]:
        c = Cooldown(cooldown * 1_000_000, st.get("next"), st.get("count", 0), st.get("first", 0))
        out = c.use(int(row["us"]))
        st.update(next=c.next_ts, count=c.count, first=c.first_ts)
        return [(row["path"], row["entry"], n, int(first), int(at)) for n, first, at in out]

    return keyed_state(
        uses, ["path", "entry"], ["us"], step, "path string, entry string, count long, first_ts long, notice_ts long"
    )


def stream_first_seen(requests: DataFrame) -> DataFrame:
    """The first request of each client program."""
    return requests.where("trim(exe) <> ''").dropDuplicates(["exe"]).select("exe")


def stream_audit_sink(findings: DataFrame, path: str, checkpoint: str, cutoff: Column | None = None, once: bool = True):
    return _start(findings, checkpoint, AuditWriter(path, cutoff), once)


def alert_batches(alerts: list, floor: str = "HIGH", gap: int = fx.ALERT_INTERVAL_SECONDS):
    """``foreachBatch`` function that appends at most one alert per batch to ``alerts``, not too close together."""
    need = {s: i + 1 for i, s in enumerate(fx.SEVERITIES)}[floor]
    last: list = []

    def each(df: DataFrame, batch_id: int) -> None:
        from veilspark.functions.text import severity_rank

        top = df.agg(F.max(severity_rank(F.col("severity"))).alias("r"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n")).first()
        if top["r"] is None or top["r"] < need or (last and (top["ts"] - last[0]).total_seconds() < gap):
            return
        last[:] = [top["ts"]]
        alerts.append((batch_id, top["ts"], top["r"], top["n"]))

    return each
