"""Registered queries: the whole reply path, from wire text to restored context and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import reply as rp
from veilspark.operators.signals import sig_cross_request_any
from veilspark.plans import audit as au
from veilspark.plans import seeded as sd
from veilspark.plans.base import plain, view
from veilspark.plans.vaulting import D_LOOSE, D_STRICT

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def _quoted(c: str) -> str:
    return f"chr(34) || replace(replace(replace({c}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n') || chr(34)"


BREAK = "chr(10) || chr(10)"


def wire(replies: str, ends: str = "") -> str:
    """Wire text of ``replies (conn, model, body)``: an event with the model, the body in deltas of 11 characters, then ``ends``."""
    return f"""
SELECT conn, CAST(0 AS BIGINT) AS seq, 'event: start' || chr(10) || 'data: {{"id":"x","model":' || {_quoted('model')} || ',"usage":{{"note":"not content"}}}}' || {BREAK} AS text FROM ({replies}) a
UNION ALL SELECT conn, CAST(1 + i AS BIGINT), 'data: {{"choices":[{{"index":0,"delta":{{"content":' || {_quoted('substr(body, CAST(1 + i * 11 AS INT), 11)')} || '}}}}]}}' || {BREAK}
FROM (SELECT conn, body, explode(sequence(0, CAST(floor((length(body) - 1) / 11) AS INT))) AS i FROM ({replies}) b WHERE body <> '') c
{ends}"""


def _duck(sql: str) -> str:
    return sql.replace("explode(sequence(0, CAST(floor((length(body) - 1) / 11) AS INT)))", "unnest(range(0, CAST(floor((length(body) - 1) / 11) AS INT) + 1))")


# Every seventh reply ends with data that is no JSON, and all with the mark of the end.
QUOTING = f"SELECT 'r' || CAST(msg_id AS STRING) AS conn, 'm' || CAST(msg_id % 3 AS STRING) AS model, session, msg_id, body FROM ({sd.REPLIES}) q"
ENDS = f"""UNION ALL SELECT conn, CAST(10001 AS BIGINT), 'data: rest of ' || conn || {BREAK} FROM ({QUOTING}) d WHERE msg_id % 7 = 0
UNION ALL SELECT conn, CAST(10002 AS BIGINT), 'data: [DONE]' || {BREAK} FROM ({QUOTING}) e"""


def contexts(s, sf):
    return rp.reply_contexts(view(s, sf, wire(QUOTING, ENDS)), view(s, sf, QUOTING).select("conn", "session"), view(s, sf, sd.VAULT)).drop("session", "blocked")


register(
    "reply_context",
    lambda s, sf: plain(contexts(s, sf)),
    f"""WITH {D_STRICT}, {D_LOOSE}, n AS (SELECT id, count(repl) AS restored, count(*) - count(repl) AS unresolved FROM (SELECT id, repl FROM sr UNION ALL SELECT id, repl FROM lr) GROUP BY id),
    g AS (SELECT id, sum(d) AS degraded FROM (SELECT id, count(*) FILTER (repl IS NOT NULL AND (exact IS NULL OR tok <> canon)) AS d FROM sr GROUP BY id UNION ALL SELECT id, count(repl) FROM lr GROUP BY id) GROUP BY id)
    SELECT 'r' || msg_id AS conn, s2.out || CASE WHEN msg_id % 7 = 0 THEN 'rest of r' || msg_id ELSE '' END || '[DONE]' AS body, 'm' || (msg_id % 3) AS response_model,
      CAST(1 + (length(r.body) + 10) // 11 AS BIGINT) AS events, coalesce(n.restored, 0) AS restored, coalesce(n.unresolved, 0) AS unresolved, CAST(coalesce(degraded, 0) AS BIGINT) AS degraded
    FROM ({sd.REPLIES}) r JOIN s2 ON s2.id = r.msg_id LEFT JOIN n ON n.id = r.msg_id LEFT JOIN g ON g.id = r.msg_id""",
)

RISKY = f"SELECT CAST(resp_id AS STRING) AS conn, resp_model AS model, body FROM ({sd.RESPONSES}) q"
EXPECTED = "CASE WHEN resp_id % 24 <> 23 THEN '' WHEN resp_id % 48 = 23 THEN 'all fine with order ' || CAST(resp_id AS STRING) ELSE 'all  fine with order ' || CAST(resp_id AS STRING) END"
ASKED = f"""SELECT CAST(r.resp_id AS STRING) AS conn, 's' AS session, r.resp_id, r.status, r.headers, r.req_text, r.req_model, t.body AS req_body, r.seq, {EXPECTED} AS expected
FROM ({sd.RESPONSES}) r JOIN ({sd.TOOL_BODIES}) t ON t.msg_id = r.resp_id"""


STRANGE = f"UNION ALL SELECT conn, CAST(20000 AS BIGINT), 'event: strange' || chr(10) || 'data: {{\"w\":1}}' || {BREAK} FROM ({RISKY}) f WHERE CAST(conn AS BIGINT) % 5 = 0"


def findings(s, sf):
    asked = view(s, sf, ASKED).withColumn("ts", F.timestamp_seconds("seq")).withColumn("own_markers", F.array().cast("array<string>"))
    reg = view(s, sf, au.MARKERS).select("nonce", F.timestamp_seconds(F.col("at")).alias("ts"))
    return rp.reply_audit(view(s, sf, wire(RISKY, STRANGE)), asked, view(s, sf, sd.VAULT), reg, au.KEYS, au.PATHS, {"cross_request_pollution": True, "tool_call_rewrite": True})[1]


D_TOOLS = au.SQL["sig_tool_injection"]
D_UNKNOWN = f"SELECT resp_id, 'sse_anomaly' AS signal, 'LOW' AS severity, 'unknown_event' AS kind, 'unknown_event: strange (count=1)' AS evidence FROM {au.RESP} WHERE resp_id % 5 = 0"
D_ECHO = f"""SELECT resp_id, 'tool_call_rewrite', 'LOW', 'tool_echo', 'expected=' || chr(39) || substr(expected, 1, 40) || chr(39) || ' actual=' || chr(39) || substr(body, 1, 40) || chr(39) || ' verdict=whitespace'
FROM (SELECT *, {EXPECTED} AS expected FROM {au.RESP}) WHERE expected <> '' AND expected <> body"""
register(
    "reply_audit",
    lambda s, sf: findings(s, sf).groupBy("signal", "severity", "kind").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("conn").alias("replies"), F.min("evidence").alias("first_evidence")),
    f"""WITH a AS (SELECT * FROM ({au.D_LEAK}) UNION ALL SELECT * FROM ({au.D_TEXT}) t WHERE resp_id IN ({au.D_GOOD})
      UNION ALL SELECT msg_id, 'tool_call_injection', severity, kind, evidence FROM ({D_TOOLS}) i UNION ALL {D_UNKNOWN} UNION ALL {D_ECHO})
    SELECT signal, severity, kind, count(*) AS findings, count(DISTINCT resp_id) AS replies, min(evidence) AS first_evidence FROM a GROUP BY ALL""",
)

# Customer names that earlier requests mentioned and later replies repeat.
MENTIONED = "SELECT ' ' || c_name AS nonce, CAST(c_custkey * 40 AS BIGINT) AS at FROM customer"
SAID = "SELECT o_orderkey AS resp_id, CAST(o_orderkey AS BIGINT) AS at, 'for Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') || ', order ' || CAST(o_orderkey AS STRING) AS body, 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS whose FROM orders"


def mentioned(s, sf):
    own = F.when(F.col("resp_id") % 4 == 0, F.array("whose")).otherwise(F.array().cast("array<string>"))
    said = view(s, sf, SAID).withColumn("ts", F.timestamp_seconds("at")).withColumn("own_markers", own)
    return sig_cross_request_any(said, view(s, sf, MENTIONED).select("nonce", F.timestamp_seconds("at").alias("ts")), ["resp_id"]).select("resp_id", "signal", "kind", "evidence")


register(
    "sig_cross_request_any",
    mentioned,
    f"""SELECT DISTINCT resp_id, 'cross_request_pollution' AS signal, 'prior_marker' AS kind, 'prior_marker_recur: ' || whose AS evidence
    FROM ({SAID}) s JOIN ({MENTIONED}) m ON trim(m.nonce) = whose WHERE m.at < s.at AND s.at - m.at < 3600 AND resp_id % 4 <> 0""",
)
