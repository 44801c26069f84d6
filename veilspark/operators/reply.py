"""The reply path: chunks to frames, text places, restored text, context, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import reply_text
from veilspark.functions.holdback import Tail
from veilspark.functions.slots import SLOT, is_object, push_slots
from veilspark.functions.spans import compute_once
from veilspark.functions.text import json_escape_inside, trim_space
from veilspark.functions.walk import ordered_walk, tasks
from veilspark.operators import signals
from veilspark.operators.cutting import WHOLE
from veilspark.operators.frames import frame_fields, frames, reply_facts, snapshots
from veilspark.operators.restore import STAT_NAMES, restore, suffix_index
from veilspark.sources.lineage import cut, fits


def pushes(fields: DataFrame) -> DataFrame:
    """``conn, frame_no, slot_no, path, channel, text, escape``: every text that a reply gives, in its order.

    Events give their known text places, else all content values.  Data that is no JSON, and lines that are no event at all, give
    themselves as text.
    """
    data = F.col("data")
    none = F.array().cast(f"array<{SLOT}>")
    plain = lambda text: F.array(F.struct(F.lit("").alias("path"), F.lit("text").alias("channel"), text.alias("text"), F.lit(False).alias("escape")))
    rows = compute_once(fields.select("conn", "frame_no", "data", "raw", "valid"), __object=is_object(data))
    rows = compute_once(rows, __found=push_slots(data, F.col("__object")))
    found = (
        F.when(data.isNull() | (trim_space(data) == ""), F.when(F.col("valid"), none).otherwise(plain(F.col("raw"))))
        .when(F.col("__object"), F.col("__found"))
        .when(F.try_parse_json(data).isNull(), plain(data))
        .otherwise(none)
    )
    rows = compute_once(rows, __slots=found.cast(f"array<{SLOT}>"))
    return rows.select("conn", "frame_no", F.posexplode("__slots").alias("slot_no", "s")).select("conn", "frame_no", "slot_no", "s.*").where("text <> ''")


def _settled(rows: DataFrame) -> DataFrame:
    """Moves the possible start of a placeholder at the end of a push to the next push of its channel; a rest comes last."""
    def step(st, row):
        st.setdefault("tail", Tail())
        st["at"] = (row["frame_no"], row["slot_no"], row["escape"])
        out = st["tail"].push(row["text"])
        return [(row["session"], row["conn"], row["channel"], False, *st["at"], out)] if out else []

    def finish(st, key):
        rest = st["tail"].finish()
        return [(key[0], key[1], key[2], True, *st["at"], rest)] if rest else []

    return ordered_walk(rows.select("session", "conn", "channel", "frame_no", "slot_no", "text", "escape"), ["session", "conn", "channel"], ["frame_no", "slot_no"], dict, step, finish,
                        "session string, conn string, channel string, rest boolean, frame_no long, slot_no int, escape boolean, body string")


def reply_context(fields: DataFrame, sessions: DataFrame, vault: DataFrame) -> DataFrame:
    """``conn, session, body, response_model, events`` and the counters of the restore, one row for each reply of ``sessions (conn, session)``.

    ``body`` is the whole restored text in the order of the stream.  A last whole text of a channel takes the place of what the channel
    gave before it.
    """
    said = pushes(fields).join(sessions, "conn")
    last = snapshots(fields).select("conn", "channel", F.col("frame_no").alias("_from"))
    said = said.join(last, ["conn", "channel"], "left").where("_from IS NULL OR frame_no >= _from")
    keys = ["conn", "channel", "rest", "frame_no", "slot_no"]
    # The restore reads its rows several times.
    back = restore(cut(_settled(said)), vault, keys, "body", "back", escape="escape")
    order = F.struct("rest", "frame_no", "slot_no", "channel", "back")
    text = back.groupBy("conn").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["back"]), "").alias("body"), *(F.sum(s).alias(s) for s in STAT_NAMES))
    facts = reply_facts(fields)
    zero = F.lit(0).cast("bigint")
    return sessions.join(text, "conn", "left").join(facts, "conn", "left").select(
        "conn", "session", F.coalesce("body", F.lit("")).alias("body"), "response_model", F.coalesce("events", zero).alias("events"), *(F.coalesce(s, zero).alias(s) for s in STAT_NAMES))


def _whole_replies(chunks: DataFrame, whole: int, tell: bool) -> DataFrame:
    """Replies read in one go by one task each, see :func:`veilspark.functions.reply_text.said`."""
    rows = chunks.where("conn IS NOT NULL").select("conn", "seq", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(tasks(rows.sparkSession), "conn").sortWithinPartitions("conn", "seq")
    return cut(rows.select("conn", "text").mapInArrow(reply_text.said(whole, tell), reply_text.SAID))


def _contexts(chunks: DataFrame, sessions: DataFrame, vault: DataFrame, whole: int, tell: bool) -> tuple[DataFrame, DataFrame]:
    """Contexts, and the events ``conn, seq, event_type, data`` that may matter for the stream signals."""
    said = _whole_replies(chunks, whole, tell)
    # Texts and values meet once, by the suffixes that a reply names.
    asked = said.select("conn", F.explode("suffixes").alias("suffix")).join(sessions, "conn")
    book = suffix_index(vault).select("session", "suffix", F.struct(
        "suffix", "placeholder", "original", F.when(F.col("original").isNotNull(), json_escape_inside(F.col("original"))).alias("escaped"), "unique_suffix").alias("v"))
    found = asked.join(book, ["session", "suffix"]).groupBy("conn", "session").agg(F.collect_list("v").alias("found"))
    rows = sessions.join(said.drop("told"), "conn", "left").join(found.withColumnRenamed("session", "_session").withColumnRenamed("conn", "_conn"), (F.col("conn") == F.col("_conn")) & (F.col("session") == F.col("_session")), "left")
    lists = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in ((c, rows.schema[c].dataType) for c in ("parts", "asks", "escapes", "suffixes", "found"))]
    rows = rows.select("conn", "session", "response_model", F.coalesce("events", F.lit(0)).cast("bigint").alias("events"), F.coalesce("unsure", F.lit(False)).alias("unsure"), *lists)
    done = cut(rows.mapInArrow(reply_text.restored, reply_text.RESTORED))
    columns = ["conn", "session", "body", "response_model", "events", *STAT_NAMES]
    sure = done.where("NOT unsure").withColumn("blocked", F.lit(0).cast("bigint")).select(*columns)
    told = said.select("conn", F.inline("told"))
    rare = done.where("unsure").select(F.col("conn").alias("_conn")).distinct()
    if fits(rare, 0):
        return sure, told
    theirs = lambda df: df.join(rare, F.col("conn") == F.col("_conn"), "left_semi")
    fields = cut(frame_fields(frames(theirs(chunks))))
    events = fields.where("data IS NOT NULL").select("conn", F.col("frame_no").alias("seq"), F.coalesce("event_type", F.lit("")).alias("event_type"), "data")
    told = told.join(rare, F.col("conn") == F.col("_conn"), "left_anti").unionByName(events)
    return sure.unionByName(reply_context(fields, theirs(sessions), vault).select(*columns)), told


def reply_contexts(chunks: DataFrame, sessions: DataFrame, vault: DataFrame, whole: int = WHOLE) -> DataFrame:
    """:func:`reply_context` of replies that come as wire text ``(conn, seq, text)``, with the same rows.

    A reply of at most ``whole`` characters is read in one go and its placeholders are looked up once.  Longer ones, those with JSON on
    which only Spark's parser can decide, and those in which a restored text names another placeholder go the way of :func:`reply_context`.
    """
    return _contexts(chunks, sessions, vault, whole, False)[0]


def reply_audit(chunks: DataFrame, requests: DataFrame, vault: DataFrame, markers: DataFrame | None = None, key_names=(), paths=(), switches: dict[str, bool] | None = None, floor: str = "LOW") -> tuple[DataFrame, DataFrame]:
    """Context and findings of replies that come as wire text ``(conn, seq, text)``.

    ``requests`` has one row a reply: ``conn, session, status, headers, req_text, req_model, req_body, ts, own_markers`` and,
    for probes, ``expected``.  All nine signals run: on the restored text, on the events, on the tool results that the
    request carried, and on an expected command.
    """
    context, events = _contexts(chunks, requests.select("conn", "session"), vault, WHOLE, True)
    pairs = requests.drop("session").join(context.select("conn", "body", F.col("response_model").alias("resp_model")), "conn")
    # Every signal reads the pairs, which are few bytes for the time their texts take: by their bytes one task would search them all.
    pairs = cut(pairs.repartition(tasks(pairs.sparkSession), "conn"))
    found = signals.run_audit(pairs, events, markers, ["conn"], key_names, paths, switches, floor, tool_body="req_body" if "req_body" in requests.columns else None,
                              expected="expected" if "expected" in requests.columns else None)
    return context, found
