"""Registered queries: risk signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.operators import signals as sg
from veilspark.plans import seeded as sd
from veilspark.plans.base import plain, q, view
from veilspark.plans.detection import D_BITS

QUERIES: dict = {}
SQL: dict[str, str] = {}
OUT = ["resp_id", "signal", "severity", "kind", "evidence"]


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def responses(s, sf):
    return view(s, sf, sd.RESPONSES, "resp_id").withColumn("ts", F.timestamp_seconds(F.col("seq")))


RESP = f"({sd.RESPONSES})"


def d_evidence(tok, kind):
    return f"{q(kind)} || ' len=' || length({tok}) || ' sha256=' || substr(sha256({tok}), 1, 16)"


def d_matches(src, text, pattern, group=0):
    """Rows of a source with each match of a pattern as ``tok``."""
    return f"SELECT *, unnest(regexp_extract_all({text}, {q(pattern)}, {group})) AS tok FROM {src}"


def d_dedupe(rows):
    return (
        f"SELECT resp_id, min(signal) AS signal, min(severity) AS severity, kind, evidence || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS evidence"
        f" FROM ({rows}) d GROUP BY resp_id, kind, evidence"
    )


HAY = f"(SELECT resp_id, body || chr(10) || headers AS hay FROM {RESP} WHERE status >= 400)"
D_CRED = " UNION ALL ".join(
    f"SELECT resp_id, 'error_leak' AS signal, '{sev}' AS severity, '{kind}' AS kind, {d_evidence('tok', kind)} AS evidence FROM ({d_matches(HAY, 'hay', p)}) m"
    f" WHERE NOT ({' OR '.join(f'contains(lower(tok), {q(w)})' for w in fx.SELF_CHECK_MARKERS)})"
    for p, kind, sev in fx.LEAK_CREDENTIALS
)
# Values are looked up after each name, because they may overlap the next name.
D_ENV = f"""SELECT resp_id, 'error_leak' AS signal, 'HIGH' AS severity, 'env_var' AS kind, 'env_var: ' || substr(name, 1, 60) AS evidence FROM (
  SELECT resp_id, m[i] AS name, regexp_extract(array_to_string(g[i+1:i+1] || flatten(list_transform(range(i + 1, len(m) + 1), lambda k: [m[k], g[k+1]])), ''), {q('^([^' + fx.ENV_VALUE_END.replace(']', chr(92) + ']') + ']*)')}, 1) AS tok
  FROM (SELECT resp_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT resp_id, regexp_extract_all(hay, {q(fx.ENV_CREDENTIAL)}) AS m, string_split_regex(hay, {q(fx.ENV_CREDENTIAL)}) AS g FROM {HAY})))
WHERE length(tok) >= 20 AND {D_BITS} >= 3.0 AND NOT ({' OR '.join(f'contains(lower(tok), {q(r)})' for r in fx.ORDERED_RUNS + [r[::-1] for r in fx.ORDERED_RUNS])})"""
D_PATHS = " UNION ALL ".join(
    f"SELECT resp_id, 'error_leak' AS signal, 'LOW' AS severity, '{kind}' AS kind, '{kind}: ' || substr(tok, 1, 60) AS evidence FROM ({d_matches(HAY, 'hay', p)}) m"
    for p, kind in fx.LEAK_PATHS
)
for _name, _parts, _sql in (
    ("sig_error_leak_credentials", (sg.leak_credentials,), D_CRED),
    ("sig_error_leak_env", (sg.leak_env,), D_ENV),
    ("sig_error_leak_paths", (sg.leak_paths,), D_PATHS),
):
    register(_name, lambda s, sf, p=_parts: sg.sig_error_leak(responses(s, sf), ["resp_id"], p).select(*OUT), d_dedupe(_sql))
D_LEAK = d_dedupe(f"{D_CRED} UNION ALL {D_ENV} UNION ALL {D_PATHS}")

D_FAM = "regexp_extract(string_split(lower(trim({c})), '/')[-1], '[a-z][a-z0-9]*')"
D_SWAP = (
    f"SELECT resp_id, 'identity_swap' AS signal, 'HIGH' AS severity, 'model_mismatch' AS kind, 'model_mismatch: req=' || req_model || ' resp=' || resp_model AS evidence FROM {RESP}"
    f" WHERE {D_FAM.format(c='req_model')} <> '' AND {D_FAM.format(c='resp_model')} <> '' AND {D_FAM.format(c='req_model')} <> {D_FAM.format(c='resp_model')}"
)
register("sig_identity_swap", lambda s, sf: sg.sig_identity_swap(responses(s, sf), ["resp_id"]).select(*OUT), D_SWAP)

ECHO = (
    "SELECT o_orderkey AS resp_id, 'pip install pkg' || CAST(o_custkey AS STRING) || '==1.0' AS expected, CASE o_orderkey % 6 WHEN 0 THEN 'pip install pkg' || CAST(o_custkey AS STRING) || '==1.0'"
    " WHEN 1 THEN '```sh' || chr(10) || 'pip install pkg' || CAST(o_custkey AS STRING) || '==1.0' || chr(10) || '```' WHEN 2 THEN '$ pip   install pkg' || CAST(o_custkey AS STRING) || '==1.0'"
    " WHEN 3 THEN 'PIP install pkg' || CAST(o_custkey AS STRING) || '==1.0' WHEN 4 THEN 'pip install other' ELSE '' END AS actual FROM orders"
)
register(
    "sig_tool_echo",
    lambda s, sf: sg.sig_tool_echo(view(s, sf, ECHO), ["resp_id"]).select(*OUT),
    f"""SELECT resp_id, 'tool_call_rewrite' AS signal, CASE WHEN v = 'whitespace' THEN 'LOW' ELSE 'MEDIUM' END AS severity, 'tool_echo' AS kind,
    'expected=''' || substr(expected, 1, 40) || ''' actual=''' || substr(actual, 1, 40) || ''' verdict=' || v AS evidence
    FROM (SELECT *, CASE WHEN resp_id % 6 IN (1, 2, 3) THEN 'whitespace' WHEN resp_id % 6 = 4 THEN 'substituted' ELSE 'exact' END AS v FROM ({ECHO})) WHERE v <> 'exact' AND actual <> ''""",
)

# --- stream events -----------------------------------------------------------------------------------------

D_EVENTS = f"""ev AS (SELECT conn, seq, coalesce(CASE WHEN json_type(data, '$.type') = 'VARCHAR' THEN json_extract_string(data, '$.type') END, event_type) AS etype,
  json_exists(data, '$.choices') OR json_exists(data, '$.delta') OR json_exists(data, '$.usage') OR json_exists(data, '$.system_fingerprint') AS open_shape,
  coalesce(TRY_CAST(json_extract_string(data, '$.usage.input_tokens') AS BIGINT), TRY_CAST(json_extract_string(data, '$.message.usage.input_tokens') AS BIGINT)) AS input,
  coalesce(TRY_CAST(json_extract_string(data, '$.usage.output_tokens') AS BIGINT), TRY_CAST(json_extract_string(data, '$.message.usage.output_tokens') AS BIGINT)) AS output,
  trim(json_extract_string(data, '$.signature_delta')) = '' AS blank, row_number() OVER (PARTITION BY conn ORDER BY seq) AS rn FROM ({sd.STREAM_EVENTS})),
fx AS (SELECT *, etype NOT IN ({', '.join(q(t) for t in fx.KNOWN_STREAM_EVENTS)}) AND NOT open_shape AS unknown FROM ev WHERE rn <= 5000)"""
D_UNKNOWN = "SELECT conn, 'unknown_event' AS kind, 'unknown_event: ' || arg_min(etype, seq) || ' (count=' || count(*) || ')' AS evidence FROM fx WHERE unknown GROUP BY conn"
D_REGRESS = (
    "SELECT conn, 'usage_regress' AS kind, arg_min('output_tokens_regress: ' || prev || ' -> ' || output, seq) AS evidence"
    " FROM (SELECT *, lag(output) OVER (PARTITION BY conn ORDER BY seq) AS prev FROM fx WHERE output IS NOT NULL) WHERE output < prev GROUP BY conn"
)
D_INCONS = (
    "SELECT conn, 'usage_inconsistent' AS kind, 'input_tokens_inconsistent: first=Some(' || arg_min(input, seq) || ') samples=' || count(input) AS evidence"
    " FROM fx WHERE input IS NOT NULL GROUP BY conn HAVING min(input) <> max(input)"
)
D_BLANK = "SELECT conn, 'empty_signature' AS kind, 'empty_signature_delta: ' || count(*) AS evidence FROM fx WHERE blank GROUP BY conn"
for _name, _kind, _sql in (
    ("sig_stream_unknown_event", "unknown_event", D_UNKNOWN),
    ("sig_stream_usage_regress", "usage_regress", D_REGRESS),
    ("sig_stream_usage_inconsistent", "usage_inconsistent", D_INCONS),
    ("sig_stream_empty_signature", "empty_signature", D_BLANK),
):
    register(
        _name,
        lambda s, sf, k=_kind: sg.sig_stream(view(s, sf, sd.STREAM_EVENTS), ["conn"], [k]).select("conn", "kind", "evidence"),
        f"WITH {D_EVENTS} {_sql}",
    )

# --- reply text ---------------------------------------------------------------------------------------------


def text_query(name, build, sql, dedupe=True):
    register(name, lambda s, sf: sg.sig_text(responses(s, sf), ["resp_id"], build(), dedupe).select(*OUT), sql)


def body():
    return F.col("body")


def asked():
    return F.col("req_text")


def d_hidden(pattern, least, sev, note):
    return (
        f"SELECT resp_id, 'response_poison' AS signal, '{sev}' AS severity, 'hidden_unicode' AS kind, 'hidden_unicode: ' || array_to_string(list_transform(m[1:5], lambda c: 'U+' || upper(lpad(to_hex(unicode(c)), 4, '0'))), ',')"
        f" || ' (count=' || len(m) || ') [{note}]' AS evidence FROM (SELECT resp_id, regexp_extract_all(body, {q(pattern)}) AS m FROM {RESP}) WHERE len(m) >= {least}"
    )


D_HIDDEN = d_hidden(fx.BIDI_CHARS, 1, "HIGH", fx.BIDI_NOTE) + " UNION ALL " + d_hidden(fx.ZERO_WIDTH_CHARS, fx.ZERO_WIDTH_MIN, "MEDIUM", fx.ZERO_WIDTH_NOTE)
text_query("sig_hidden_unicode", lambda: sg.hidden_unicode(body()), D_HIDDEN)


def d_exfil(src, key="resp_id"):
    urls = " UNION ALL ".join(d_matches(f"({src})", "plain", p, 1) for p in (fx.MARKDOWN_IMAGE, fx.HTML_SRC))
    return (
        f"SELECT {key}, 'response_poison' AS signal, 'HIGH' AS severity, 'exfil_url' AS kind, 'exfil_url host=' || regexp_extract(tok, '://([^/?]*)', 1) || ' len=' || length(tok) || ' sha256=' || substr(sha256(tok), 1, 16)"
        f" || ' [渲染即自动请求，query 载荷 ' || length(regexp_extract(tok, {q(fx.QUERY_PAYLOAD)}, 1)) || ' 字符]' AS evidence FROM ({urls}) u WHERE regexp_extract(tok, {q(fx.QUERY_PAYLOAD)}, 1) <> ''"
    )


# The only fenced reply template is one whole block, so the fence rule is a plain cut in the oracle.
D_EXFIL = d_exfil(f"SELECT resp_id, regexp_replace(body, '```md(.|\\n)*```\\n', '') AS plain FROM {RESP}")
text_query("sig_exfil_url", lambda: sg.exfil_urls(body()), D_EXFIL)
PAGE_TEXT = "SELECT page_id, html || '<img src=\"' || url || '?payload=' || md5(url) || '\">' AS html FROM pages"
register(
    "sig_exfil_url_pages",
    lambda s, sf: sg.sig_text(view(s, sf, PAGE_TEXT, "page_id"), ["page_id"], sg.exfil_urls(F.col("html"))).select("page_id", "kind", "evidence"),
    f"SELECT page_id, kind, evidence FROM ({d_exfil(f'SELECT page_id, html AS plain FROM ({PAGE_TEXT}) p', 'page_id')}) x",
)
D_ECHOES = " UNION ALL ".join(
    f"SELECT resp_id, 'response_poison' AS signal, 'MEDIUM' AS severity, '{k}' AS kind, {d_evidence('tok', k)} AS evidence FROM ({d_matches(RESP, 'body', p)}) m WHERE NOT contains(req_text, tok)"
    for p, k in fx.CREDENTIAL_ECHOES
)
text_query("sig_credential_echo", lambda: sg.credential_echoes(body(), asked()), d_dedupe(D_ECHOES))

D_CLIP = "CASE WHEN length(trim({c}, ' ' || chr(9) || chr(10) || chr(13))) > 120 THEN substr(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), 1, 117) || '...' ELSE trim({c}, ' ' || chr(9) || chr(10) || chr(13)) END"


def d_commands(src, text, check=True, request="req_text"):
    parts = []
    kinds = list(dict.fromkeys(k for _, k, _, _ in fx.COMMANDS))
    for i, (p, kind, desc, test) in enumerate(fx.COMMANDS):
        cond = f"NOT contains({request}, trim(tok, ' ' || chr(10)))" if check else "true"
        if check and test == "no_where":
            cond += " AND NOT contains(lower(tok), 'where')"
        if check and test == "forced_push":
            cond += " AND NOT contains(tok, '--force-with-lease') AND (contains(tok, '--force') OR regexp_matches(tok, '(^|[^A-Za-z0-9_-])-f($|[^A-Za-z0-9_-])'))"
        pat = q(p.replace(r"\z", "$"))
        parts.append(
            f"SELECT *, {i} AS pi, {kinds.index(kind)} AS ki, '{kind}' AS kind, {q(desc)} || ': ' || {D_CLIP.format(c='tok')} AS ev FROM"
            f" (SELECT *, m[i] AS tok FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all({text}, {pat}) AS m FROM {src}))) WHERE {cond}"
        )
    return " UNION ALL ".join(parts)


D_DANGER = f"SELECT resp_id, 'dangerous_action' AS signal, 'LOW' AS severity, kind, arg_min(ev, (pi, i)) AS evidence FROM ({d_commands(RESP, 'body')}) c GROUP BY resp_id, kind"
text_query("sig_dangerous_action", lambda: sg.dangerous_actions(body(), asked()), D_DANGER, False)
KEYS = ["MAIN_DB_PASSWORD", "abc"]
PATHS = ["/srv/secrets/prod.pem", "*.kdbx"]


def d_access():
    parts = []
    for i, (p, kind, desc) in enumerate(fx.PROTECTED_OBJECTS):
        parts.append(f"SELECT resp_id, '{kind}' AS kind, {i} AS pi, {q(desc)} || ': ' || substr(regexp_extract(body, {q(p)}), 1, 120) AS ev FROM {RESP} WHERE regexp_matches(body, {q(p)})")
    parts.append(f"SELECT resp_id, 'locker_key', 90, '{fx.LOCKER_KEY_NOTE}: MAIN_DB_PASSWORD' FROM {RESP} WHERE contains(body, 'MAIN_DB_PASSWORD')")
    parts.append(f"SELECT resp_id, 'protected_path', 91, '{fx.LOCKER_PATH_NOTE}: /srv/secrets/prod.pem' FROM {RESP} WHERE contains(body, 'prod.pem')")
    return f"SELECT resp_id, 'locker_access' AS signal, 'MEDIUM' AS severity, kind, arg_min(ev, pi) AS evidence FROM ({' UNION ALL '.join(parts)}) a GROUP BY resp_id, kind"


text_query("sig_locker_access", lambda: sg.locker_access(body(), KEYS, PATHS), d_access(), False)

# Markers are registered by customers; a reply may repeat one that is old, new, later or its own.
MARKERS = "SELECT 'MARK_' || CAST(c_custkey AS STRING) || '_' || substr(md5(CAST(c_custkey AS STRING)), 1, 8) AS nonce, c_custkey * 7 AS at FROM customer"


def cross(s, sf):
    resp = responses(s, sf).withColumn(
        "own_markers", F.when(F.col("resp_id") % 5 == 0, F.regexp_extract_all("body", F.lit(fx.MARKER_PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    )
    reg = view(s, sf, MARKERS).select("nonce", F.timestamp_seconds(F.col("at")).alias("ts"))
    return sg.sig_cross_request(resp, reg, ["resp_id"])


D_CROSS = f"""SELECT DISTINCT resp_id, 'cross_request_pollution' AS signal, 'HIGH' AS severity, 'prior_marker' AS kind, 'prior_marker_recur: ' || nonce AS evidence
FROM ({d_matches(RESP, 'body', fx.MARKER_PATTERN)}) r JOIN ({MARKERS.replace('AS at', 'AS reg_at')}) m ON m.nonce = r.tok WHERE reg_at < seq AND seq - reg_at < 3600 AND resp_id % 5 <> 0"""
register("sig_cross_request", lambda s, sf: cross(s, sf).select(*OUT), D_CROSS)

# --- tool results ----------------------------------------------------------------------------------------------

TOOL_EV = {
    0: ("MEDIUM", "destructive_fs", "'[tool#1] 递归删除根目录/家目录: rm -rf /'"),
    1: ("MEDIUM", "destructive_db", "'[tool_result#0] 删除表: drop table'"),
    2: ("MEDIUM", "destructive_fs", "'[functionResponse[read]#0] 格式化磁盘: format c:'"),
    4: ("LOW", "forged_system_label", "'[tool#0] 伪造系统标记: <|im_start|>'"),
}
register(
    "sig_tool_injection",
    lambda s, sf: sg.sig_tool_injection(view(s, sf, sd.TOOL_BODIES, "msg_id"), ["msg_id"]).select("msg_id", "severity", "kind", "evidence"),
    " UNION ALL ".join(
        f"SELECT msg_id, '{sev}' AS severity, '{kind}' AS kind, {ev} AS evidence FROM ({sd.TOOL_BODIES}) WHERE msg_id % 7 = {k}" for k, (sev, kind, ev) in TOOL_EV.items()
    )
    + f" UNION ALL SELECT msg_id, 'LOW', 'forged_system_label', '[tool#0] 伪造系统标记: [INST]' FROM ({sd.TOOL_BODIES}) WHERE msg_id % 7 = 5"
    + f" UNION ALL SELECT msg_id, 'MEDIUM', 'destructive_vcs', '[tool#1] git reset --hard: git reset --hard' FROM ({sd.TOOL_BODIES}) WHERE msg_id % 7 = 5",
)

# --- merged -------------------------------------------------------------------------------------------------------

register(
    "dedupe_findings",
    lambda s, sf: sg.dedupe_findings(
        view(s, sf, sd.AUDIT_EVENTS).select("sid", F.col("id").alias("pos"), F.col("signal_type").alias("signal"), "severity", F.col("host").alias("kind"), "evidence"), ["sid"]
    ).select("sid", "pos", "signal", "severity", "kind", "evidence"),
    f"SELECT sid, min(id) AS pos, arg_min(signal_type, id) AS signal, arg_min(severity, id) AS severity, host AS kind, evidence || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS evidence"
    f" FROM ({sd.AUDIT_EVENTS}) GROUP BY sid, host, evidence",
)
register(
    "signal_gate",
    lambda s, sf: plain(sg.signal_gate(
        view(s, sf, sd.AUDIT_EVENTS).withColumnRenamed("signal_type", "signal"), switches={"sse_anomaly": False}, floor="HIGH").select("id", "signal", "severity")),
    f"SELECT id, signal_type AS signal, severity FROM ({sd.AUDIT_EVENTS}) WHERE signal_type <> 'sse_anomaly' AND severity IN ('HIGH', 'CRITICAL')",
)


def audited(s, sf):
    pairs = responses(s, sf).withColumn("own_markers", F.array().cast("array<string>"))
    reg = view(s, sf, MARKERS).select("nonce", F.timestamp_seconds(F.col("at")).alias("ts"))
    return sg.run_audit(pairs, None, reg, ["resp_id"], KEYS, PATHS, {"cross_request_pollution": True}, "LOW")


D_GOOD = f"SELECT resp_id FROM {RESP} WHERE status < 400"
D_TEXT = " UNION ALL ".join([D_HIDDEN, D_EXFIL, d_dedupe(D_ECHOES), D_DANGER, d_access(), D_SWAP, D_CROSS.replace(" AND resp_id % 5 <> 0", "")])
register(
    "run_audit",
    lambda s, sf: audited(s, sf).groupBy("signal", "severity", "kind").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("resp_id").alias("replies"), F.min("evidence").alias("first_evidence")),
    f"""WITH a AS (SELECT * FROM ({D_LEAK}) UNION ALL SELECT * FROM ({D_TEXT}) t WHERE resp_id IN ({D_GOOD}))
    SELECT signal, severity, kind, count(*) AS findings, count(DISTINCT resp_id) AS replies, min(evidence) AS first_evidence FROM a GROUP BY ALL""",
)
CONV = "SELECT conv_id * 1000 + turn AS resp_id, text AS body, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS req_text, role FROM conversations"
register(
    "credential_echo_conversations",
    lambda s, sf: sg.sig_text(
        view(s, sf, CONV).where("role = 'assistant'").withColumn("body", F.concat("body", F.lit(" token ghp_"), F.md5("body"))), ["resp_id"],
        sg.credential_echoes(F.col("body"), F.col("req_text")), True).select("resp_id", "kind", "evidence"),
    f"SELECT resp_id, 'credential_echo:github_token' AS kind, {d_evidence('tok', 'credential_echo:github_token')} AS evidence FROM (SELECT resp_id, 'ghp_' || md5(body) AS tok FROM ({CONV}) WHERE role = 'assistant')",
)
