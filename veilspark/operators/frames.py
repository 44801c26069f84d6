"""Event-stream replies: bytes to text, frames, fields, text slots, channels, reply context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.holdback import Frames, Tail
from veilspark.functions.json_text import vstr
from veilspark.functions.slots import is_object, push_slots, text_slots
from veilspark.functions.spans import compute_once
from veilspark.functions.text import trim_space
from veilspark.functions.walk import ordered_walk
from veilspark.operators.cutting import cut_frames, decode
from veilspark.operators.restore import restore


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """``(conn, seq, chunk BINARY)`` to ``(conn, seq, text)``; the rest of a reply gets the next seq."""
    return decode(chunks)


def frames(chunks: DataFrame, max_backlog: int | None = None) -> DataFrame:
    """``(conn, seq, text)`` to ``(conn, frame_no, raw, forced)``.

    Frames may be of any length.  With ``max_backlog`` bytes an unfinished frame beyond them is forced out after the chunk that
    passes them; that depends on every chunk before, so each reply is then read by one task.
    """
    if max_backlog is None:
        return cut_frames(chunks).withColumn("forced", F.lit(False))

    def start():
        return {"cut": Frames(max_backlog), "n": 0}

    def emit(st, conn, found):
        out = []
        for raw, forced in found:
            out.append((conn, st["n"], raw, forced))
            st["n"] += 1
        return out

    return ordered_walk(
        chunks.select("conn", "seq", "text"),
        ["conn"],
        ["seq"],
        start,
        lambda st, row: emit(st, row["conn"], st["cut"].push(row["text"] or "")),
        lambda st, key: emit(st, key[0], st["cut"].finish()),
        "conn string, frame_no long, raw string, forced boolean",
    )


def frame_fields(cut: DataFrame) -> DataFrame:
    """Add ``data``, ``kind``, ``valid`` and ``event_type`` to frames."""
    lines = F.filter(F.transform(F.split("raw", "\n"), lambda s: F.regexp_replace(s, "\r\\z", "")), lambda s: s != "")
    df = cut.withColumn("__lines", lines)
    data_lines = F.filter("__lines", lambda s: F.startswith(s, F.lit("data:")))
    payload = F.array_join(F.transform(data_lines, lambda s: F.regexp_replace(s, "^data: ?", "")), "\n")
    field = r"^(?:data:|event:|id:|retry:|:)"
    forced = F.col("forced") if "forced" in cut.columns else F.lit(False)
    data = F.when(~forced & (F.size(data_lines) > 0), payload)
    first_event = F.get(F.filter("__lines", lambda s: F.startswith(s, F.lit("event:"))), F.lit(0))
    return (
        df.withColumn("data", data)
        .withColumn(
            "kind",
            F.when(F.col("data").isNull(), "other")
            .when(trim_space(F.col("data")) == "[DONE]", "done")
            .when(F.contains("data", F.lit("tool_calls")), "tool_call")
            .otherwise("data"),
        )
        .withColumn("valid", ~forced & (F.size("__lines") > 0) & F.forall("__lines", lambda s: F.rlike(s, F.lit(field))))
        .withColumn("event_type", F.trim(F.regexp_replace(first_event, "^event:", "")))
        .drop("__lines")
    )


def slots(fields: DataFrame) -> DataFrame:
    """One row per text slot of every data frame, in stream order."""
    df = fields.where("data IS NOT NULL")
    return df.select("conn", "frame_no", F.posexplode(text_slots(F.col("data"))).alias("slot_no", "s")).select(
        "conn", "frame_no", "slot_no", "s.*"
    )


def realign(pieces: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Move the possible start of a placeholder from the end of a piece to the next piece of its channel.

    Afterwards every placeholder lies inside one piece, so pieces can be restored one by one.  The rest
    of a channel leaves as a last piece.  Output: keys, ``piece``, ``text``, ``overflowed``.
    """

    def start():
        return {"tail": Tail(), "n": 0}

    def step(st, row):
        out = st["tail"].push(row[text] or "")
        st["n"] += 1
        if not out:
            return []
        return [(*(row[k] for k in keys), st["n"] - 1, out, False)]

    def finish(st, key):
        rest = st["tail"].finish()
        return [(*key, st["n"], rest, False)] if rest else []

    types = dict(pieces.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", piece long, text string, overflowed boolean"
    return ordered_walk(pieces.select(*keys, *order, text), keys, order, start, step, finish, schema)


def restore_pieces(pieces: DataFrame, vault: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Restore ordered pieces of reply channels; joining the results equals restoring the joined text.

    ``keys`` must hold ``session``.
    """
    cut = realign(pieces, keys, order).withColumnRenamed("text", "body")
    return restore(cut, vault, [*keys, "piece"])


def snapshots(fields: DataFrame) -> DataFrame:
    """``conn, channel, frame_no`` of the last event that gives a channel's text as a whole."""
    kind = vstr(F.try_parse_json("data"), "$.type")
    # Hardly an event names such a kind, and only those are parsed; a backslash may hide its letters.
    named = F.rlike("data", F.lit("|".join(re.escape(k) for k in fx.SNAPSHOT_CHANNELS) + r"|\\"))
    table = F.create_map(*[F.lit(x) for pair in fx.SNAPSHOT_CHANNELS.items() for x in pair])
    rows = fields.where("data IS NOT NULL").withColumn("channel", F.when(named, F.try_element_at(table, kind))).where("channel IS NOT NULL")
    return rows.groupBy("conn", "channel").agg(F.max("frame_no").alias("frame_no"))


def channel_text(rows: DataFrame, by: list[str], order: list[str], text: str = "text", resets: DataFrame | None = None) -> DataFrame:
    """The text of each reply channel.

    With ``resets`` (see :func:`snapshots`) a channel begins anew with its last whole text: what came before, also a held end, is stale.
    """
    if resets is not None:
        rows = rows.join(resets.withColumnRenamed("frame_no", "_from"), ["conn", "channel"], "left").where("_from IS NULL OR frame_no >= _from").drop("_from")
    return rows.groupBy(*by).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda s: s[text]), ""
        ).alias("body")
    )


def event_text(fields: DataFrame) -> DataFrame:
    """Pushes of audit text per event: its slots, or for events without slots all content values."""
    df = fields.where("data IS NOT NULL").select("conn", "frame_no", F.posexplode(push_slots(F.col("data"))).alias("slot_no", "s"))
    return df.select("conn", "frame_no", "slot_no", F.col("s.text").alias("text")).where("text <> ''")


def reply_facts(fields: DataFrame) -> DataFrame:
    """``conn, response_model, events``: the first model that is named and the number of events."""
    data, v = F.col("data"), F.try_parse_json("data")
    model = F.coalesce(vstr(v, "$.model"), vstr(v, "$.message.model"), vstr(v, "$.response.model"))
    # Most events name no model; a backslash may hide the letters of the key.
    model = F.when(F.contains(data, F.lit("model")) | F.contains(data, F.lit("\\")), model)
    named = F.when(trim_space(F.col("model")) != "", F.col("model"))
    events = compute_once(fields.where("data IS NOT NULL").select("conn", "frame_no", "data"), object=is_object(data)).where("object")
    return events.select("conn", "frame_no", model.alias("model")).groupBy("conn").agg(
        F.min_by(named, F.when(named.isNotNull(), F.col("frame_no"))).alias("response_model"), F.count(F.lit(1)).alias("events"))


def response_context(fields: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Per reply: audit text of whole pushes, truncation flag, first model, event count.

    With ``max_bytes`` pushes that don't fit any more are left out and ``truncated`` is set.
    """
    pushes = event_text(fields)

    def start():
        return {"parts": [], "size": 0, "cut": False}

    def step(st, row):
        n = len(row["text"].encode())
        if st["size"] + n > max_bytes:
            st["cut"] = True
        else:
            st["parts"].append(row["text"])
            st["size"] += n
        return []

    def finish(st, key):
        return [(key[0], "".join(st["parts"]), st["cut"])]

    if max_bytes is None:
        text = channel_text(pushes, ["conn"], ["frame_no", "slot_no"]).select("conn", F.col("body").alias("restored_text"), F.lit(False).alias("truncated"))
    else:
        text = ordered_walk(
            pushes, ["conn"], ["frame_no", "slot_no"], start, step, finish, "conn string, restored_text string, truncated boolean"
        )
    facts = reply_facts(fields)
    return facts.join(text, "conn", "left").select(
        "conn", F.coalesce("restored_text", F.lit("")).alias("restored_text"), "response_model", "events",
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )
