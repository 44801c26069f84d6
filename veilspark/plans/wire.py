"""Registered queries: sources, frames, slots, reply context, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import frames as fr
from veilspark.plans import seeded as sd
from veilspark.plans.base import plain, table, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def chunks(s, sf):
    return view(s, sf, sd.CHUNKS)


# Each wire chunk is re-cut at an odd place, so that frames span chunks.
RECUT = f"""
SELECT conn, seq * 2 AS seq, substr(text, 1, CAST(5 + seq % 37 AS INT)) AS text FROM ({sd.CHUNKS}) c
UNION ALL SELECT conn, seq * 2 + 1, substr(text, CAST(6 + seq % 37 AS INT)) FROM ({sd.CHUNKS}) c
"""


def fields(s, sf):
    return fr.frame_fields(fr.frames(view(s, sf, RECUT)))


D_FRAMES = f"fr AS (SELECT conn, row_number() OVER (PARTITION BY conn ORDER BY seq) - 1 AS frame_no, text AS raw, data, event_type, seq FROM (SELECT c.*, e.data, e.event_type FROM ({sd.CHUNKS}) c JOIN ({sd.STREAM_EVENTS}) e USING (seq)))"
register(
    "frames",
    lambda s, sf: fr.frames(view(s, sf, RECUT)).select("conn", "frame_no", "raw", "forced"),
    f"WITH {D_FRAMES} SELECT conn, frame_no, raw, false AS forced FROM fr",
)
register(
    "frame_fields",
    lambda s, sf: fields(s, sf).select("conn", "frame_no", "data", "kind", "valid", F.coalesce("event_type", F.lit("-")).alias("event_type")),
    f"WITH {D_FRAMES} SELECT conn, frame_no, data, CASE WHEN contains(data, 'tool_calls') THEN 'tool_call' ELSE 'data' END AS kind, true AS valid, coalesce(nullif(event_type, ''), '-') AS event_type FROM fr",
)
D_SLOTS = f"""{D_FRAMES},
sl AS (
  SELECT conn, frame_no, 0 AS slot_no, 'delta.text' AS path, 'content:' || json_extract_string(data, '$.index') AS channel, json_extract_string(data, '$.delta.text') AS text, false AS escape FROM fr WHERE seq % 6 = 1
  UNION ALL SELECT conn, frame_no, 0, 'delta.partial_json', 'args:1', json_extract_string(data, '$.delta.partial_json'), true FROM fr WHERE seq % 6 = 3
  UNION ALL SELECT conn, frame_no, 0, 'choices[0].delta.content', 'content:0', json_extract_string(data, '$.choices[0].delta.content'), false FROM fr WHERE seq % 6 = 4
  UNION ALL SELECT conn, frame_no, 1, 'choices[0].delta.tool_calls[0].function.arguments', 'args:2', json_extract_string(data, '$.choices[0].delta.tool_calls[0].function.arguments'), true FROM fr WHERE seq % 6 = 4)"""
register(
    "text_slots",
    lambda s, sf: plain(fr.slots(fields(s, sf))),
    f"WITH {D_SLOTS} SELECT conn, frame_no, CAST(slot_no AS BIGINT) AS slot_no, path, channel, text, escape FROM sl",
)
register(
    "channel_text",
    lambda s, sf: fr.channel_text(fr.slots(fields(s, sf)), ["conn", "channel"], ["frame_no", "slot_no"]),
    f"WITH {D_SLOTS} SELECT conn, channel, string_agg(text, '' ORDER BY frame_no, slot_no) AS body FROM sl GROUP BY conn, channel",
)
# Some replies give the text of a channel as a whole now and then; the delta before a snapshot is stale.
SNAPSHOTS = f"""
SELECT conn, seq, CASE seq % 7 WHEN 3 THEN '{{"type":"response.output_text.done","text":"whole ' || CAST(seq AS STRING) || '"}}'
  WHEN 5 THEN '{{"type":"response.function_call_arguments.delta","delta":"a' || CAST(seq AS STRING) || '"}}'
  WHEN 6 THEN '{{"type":"response.function_call_arguments.done","arguments":"b"}}' ELSE '{{"type":"response.output_text.delta","delta":"piece ' || CAST(seq AS STRING) || ' "}}' END AS data
FROM ({sd.STREAM_EVENTS}) e
"""


def snapshot_text(s, sf):
    f = fr.frame_fields(fr.frames(view(s, sf, f"SELECT conn, seq, 'data: ' || data || chr(10) || chr(10) AS text FROM ({SNAPSHOTS}) x")))
    return fr.channel_text(fr.slots(f), ["conn", "channel"], ["frame_no", "slot_no"], resets=fr.snapshots(f))


register(
    "channel_text_snapshots",
    snapshot_text,
    f"""WITH e AS (SELECT conn, seq, json_extract_string(data, '$.type') AS kind, coalesce(json_extract_string(data, '$.delta'), json_extract_string(data, '$.text')) AS text FROM ({SNAPSHOTS}) x),
    c AS (SELECT *, CASE WHEN kind LIKE '%function_call_arguments%' THEN 'args:0' ELSE 'content:0' END AS channel FROM e),
    l AS (SELECT conn, channel, max(seq) AS last FROM c WHERE kind LIKE '%.done' GROUP BY ALL)
    SELECT c.conn, c.channel, string_agg(text, '' ORDER BY seq) AS body FROM c LEFT JOIN l ON l.conn = c.conn AND l.channel = c.channel
    WHERE text IS NOT NULL AND (last IS NULL OR seq >= last) GROUP BY ALL""",
)
register(
    "response_context",
    lambda s, sf: plain(fr.response_context(fields(s, sf))),
    f"""WITH {D_SLOTS}, pushes AS (SELECT conn, frame_no, slot_no, text FROM sl
      UNION ALL SELECT conn, frame_no, 0, json_extract_string(data, '$.body') FROM fr WHERE seq % 6 = 5),
    t AS (SELECT conn, string_agg(text, '' ORDER BY frame_no, slot_no) AS restored_text FROM pushes GROUP BY conn),
    m AS (SELECT conn, arg_min(coalesce(json_extract_string(data, '$.model'), json_extract_string(data, '$.message.model')), frame_no) FILTER (seq % 6 IN (0, 4)) AS response_model, least(count(*), 5000) AS events FROM fr GROUP BY conn)
    SELECT m.conn, coalesce(restored_text, '') AS restored_text, response_model, events, false AS truncated FROM m LEFT JOIN t USING (conn)""",
)


def byte_chunks(s, sf):
    """Documents as bytes, cut every 1,000 bytes, so that characters span chunks."""
    raw = table(s, sf, "documents").select(F.col("doc_id").cast("string").alias("conn"), F.encode("text", "UTF-8").alias("b"))
    at = F.sequence(F.lit(0), F.floor(F.octet_length("b") / 1000).cast("int"))
    return raw.select("conn", "b", F.explode(at).alias("seq")).select(
        "conn", F.col("seq").cast("bigint").alias("seq"), F.expr("substring(b, seq * 1000 + 1, 1000)").alias("chunk"))


register(
    "decode_chunks",
    lambda s, sf: fr.channel_text(fr.decode_chunks(byte_chunks(s, sf)), ["conn"], ["seq"]).select("conn", F.sha2("body", 256).alias("digest")),
    "SELECT CAST(doc_id AS VARCHAR) AS conn, sha256(text) AS digest FROM documents",
)
