"""Registered queries: scalar functions, JSON leaves, tool results, policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions import json_text as jt
from veilspark.functions import text as tx
from veilspark.functions.checks import shannon_bits
from veilspark.operators import detect as dt
from veilspark.operators import policy as pl
from veilspark.plans import seeded as sd
from veilspark.plans.base import d_scan, d_splice, plain, q, table, view
from veilspark.plans.detection import D_BITS, LABEL_SQL, LOCKER, _in, _label, docs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def d_host(c):
    return f"lower(trim(split_part({c}, ':', 1)))"


def d_norm(c):
    return f"lower(trim(split_part(split_part(regexp_replace(trim({c}), '^.*?//', ''), '/', 1), ':', 1)))"


URLS = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ' ' || upper(url) || ' ' WHEN page_id % 3 = 1 THEN url ELSE regexp_extract(url, '://([^/]+)', 1) || ':8443/x' END AS url FROM pages"
register(
    "normalize_host",
    lambda s, sf: view(s, sf, URLS).select("page_id", tx.normalize_host(F.col("url")).alias("host")),
    f"SELECT page_id, {d_norm('url')} AS host FROM ({URLS})",
)
HOST_LIST = (
    "SELECT page_id AS pos, CASE page_id % 5 WHEN 0 THEN 'bad host!' WHEN 1 THEN 'nodot' || CAST(page_id AS STRING) WHEN 2 THEN ' ' WHEN 3 THEN repeat('a.', 200) ELSE url END AS host FROM pages"
)
D_CLEAN = f"""n AS (SELECT pos, {d_norm('host')} AS host FROM ({HOST_LIST})),
r AS (SELECT pos, host, CASE WHEN length(host) > 253 THEN 'too_long' WHEN NOT regexp_full_match(host, '[A-Za-z0-9._-]+') THEN 'illegal_character'
  WHEN NOT contains(host, '.') THEN 'no_dot' END AS reason FROM n WHERE host <> '')"""
register(
    "clean_hosts",
    lambda s, sf: plain(pl.clean_hosts(view(s, sf, HOST_LIST))[0]),
    f"WITH {D_CLEAN} SELECT min(pos) AS pos, host FROM r WHERE reason IS NULL GROUP BY host",
)
register(
    "clean_hosts_rejects",
    lambda s, sf: plain(pl.clean_hosts(view(s, sf, HOST_LIST))[1]),
    f"WITH {D_CLEAN} SELECT pos, host, reason FROM r WHERE reason IS NOT NULL",
)


def d_class(c):
    h = d_host(c)
    ends = " OR ".join(f"{h} = {q(x)} OR ends_with({h}, {q('.' + x)})" for x in fx.GUARDED_SUFFIXES)
    return f"CASE WHEN {h} IN {_in(fx.GUARDED_HOSTS)} OR {d_norm(c)} = 'relay3.example.com' THEN 'exact' WHEN {ends} THEN 'suffix' ELSE 'none' END"


register(
    "guarded_host_class",
    lambda s, sf: view(s, sf, sd.REQUESTS).select("req_id", "host", tx.guarded_host_class(F.col("host"), ["relay3.example.com"]).alias("class")),
    f"SELECT req_id, host, {d_class('host')} AS class FROM ({sd.REQUESTS})",
)
PATTERN = "CASE req_id % 4 WHEN 0 THEN 'OpenAI.com' WHEN 1 THEN 'deepseek.com' WHEN 2 THEN ' ' ELSE 'example.com' END"
register(
    "domain_matches",
    lambda s, sf: view(s, sf, f"SELECT req_id, host, {PATTERN} AS pattern FROM ({sd.REQUESTS}) r").select(
        "req_id", tx.domain_matches(F.col("pattern"), F.col("host")).alias("match")),
    f"SELECT req_id, p <> '' AND h <> '' AND (h = p OR ends_with(h, '.' || p)) AS match FROM (SELECT req_id, {d_host('host')} AS h, lower(trim({PATTERN})) AS p FROM ({sd.REQUESTS}) r)",
)
PROC = "CASE req_id % 5 WHEN 0 THEN 'agent.exe' WHEN 1 THEN 'C:' || chr(92) || 'Apps' || chr(92) WHEN 2 THEN '/usr/bin' WHEN 3 THEN 'd:/work/ide/CODE.exe' ELSE 'curl' END"
register(
    "process_path_matches",
    lambda s, sf: view(s, sf, f"SELECT req_id, exe, {PROC} AS pattern FROM ({sd.REQUESTS}) r").select(
        "req_id", tx.process_path_matches(F.col("pattern"), F.col("exe")).alias("match")),
    f"SELECT req_id, e = p OR starts_with(e, p || chr(92)) OR starts_with(e, p || '/') OR (NOT contains(p, chr(92)) AND NOT contains(p, '/') AND ends_with(e, chr(92) || p)) AS match"
    f" FROM (SELECT req_id, lower(trim(exe)) AS e, rtrim(lower(trim({PROC})), '/' || chr(92)) AS p FROM ({sd.REQUESTS}) r)",
)
SESSIONS = (
    "SELECT event_id AS req_id, 'h' || CAST(event_id % 3 AS STRING) AS host, 'c' || CAST(user_id AS STRING) AS client,"
    " CASE event_id % 6 WHEN 0 THEN '{\"conversation_id\":\" c1 \",\"user\":\"u\"}' WHEN 1 THEN '{\"session_id\":7,\"user\":\"u' || CAST(user_id AS STRING) || '\"}' WHEN 2 THEN '{\"thread_id\":\"\"}' WHEN 3 THEN 'no json' ELSE props END AS body,"
    " CASE event_id % 4 WHEN 0 THEN ' s9 ' ELSE '' END AS xsid, CASE event_id % 5 WHEN 0 THEN 'Bearer ' || CAST(user_id AS STRING) ELSE '' END AS auth FROM events"
)
register(
    "derive_session",
    lambda s, sf: view(s, sf, SESSIONS).select(
        "req_id",
        tx.derive_session(F.col("host"), F.col("body"), F.create_map(F.lit("x-session-id"), F.col("xsid"), F.lit("authorization"), F.col("auth")), F.col("client")).alias("session"),
    ),
    "SELECT req_id, coalesce('conv:' || host || ':' || coalesce("
    + ", ".join(f"CASE WHEN json_valid(body) AND json_type(body, '$.{k}') = 'VARCHAR' THEN nullif(trim(json_extract_string(body, '$.{k}')), '') END" for k in fx.SESSION_BODY_KEYS)
    + "), 'hdr:' || host || ':' || nullif(trim(xsid), ''), CASE WHEN trim(auth) <> '' THEN 'key:' || host || ':' || substr(sha256(auth), 1, 16) END, client) AS session"
    f" FROM ({SESSIONS})",
)
register(
    "host_from_session",
    lambda s, sf: view(s, sf, sd.REQUEST_LOG).select("id", tx.host_from_session(F.when(F.col("id") % 3 == 0, F.col("host")).otherwise(F.col("session"))).alias("host")),
    f"SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE host END AS host FROM ({sd.REQUEST_LOG})",
)
register(
    "body_hash",
    lambda s, sf: docs(s, sf).select("doc_id", tx.short_hash(F.col("body")).alias("hash")),
    "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents",
)
register(
    "truncate_sample",
    lambda s, sf: docs(s, sf).select("doc_id", F.sha2(tx.truncate_sample(F.col("body"), 1000), 256).alias("digest")),
    "SELECT doc_id, sha256(CASE WHEN strlen(text) > 1000 THEN substr(text, 1, 250) ELSE text END) AS digest FROM documents",
)
register(
    "model_family",
    lambda s, sf: view(s, sf, sd.RESPONSES).select("resp_id", tx.model_family(F.col("req_model")).alias("asked"), tx.model_family(F.col("resp_model")).alias("got")),
    "SELECT resp_id, regexp_extract(string_split(lower(trim(req_model)), '/')[-1], '[a-z][a-z0-9]*') AS asked,"
    f" regexp_extract(string_split(lower(trim(resp_model)), '/')[-1], '[a-z][a-z0-9]*') AS got FROM ({sd.RESPONSES})",
)
D_RANK = "CASE upper({c}) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE {u} END"
register(
    "severity_rank",
    lambda s, sf: plain(view(s, sf, sd.AUDIT_EVENTS).select("id", tx.severity_rank(F.col("severity")).alias("rank"), tx.severity_rank(F.col("sid"), 1).alias("unknown"))),
    f"SELECT id, CAST({D_RANK.format(c='severity', u=0)} AS BIGINT) AS rank, CAST({D_RANK.format(c='sid', u=1)} AS BIGINT) AS unknown FROM ({sd.AUDIT_EVENTS})",
)
register(
    "redact_evidence",
    lambda s, sf: docs(s, sf).select("doc_id", tx.redact_evidence(F.col("body"), "text").alias("evidence")),
    "SELECT doc_id, 'text len=' || length(text) || ' sha256=' || substr(sha256(text), 1, 16) AS evidence FROM documents",
)


def d_safe(c, limit=0):
    for p, r in fx.REPORT_CLEANUP:
        c = f"regexp_replace({c}, {q(p)}, {q(r.replace('$1', chr(92) + '1'))}, 'g')"
    return f"substr({c}, 1, {limit})" if limit else c


register(
    "safe_text",
    lambda s, sf: view(s, sf, sd.RESPONSES).select("resp_id", tx.safe_text(F.col("body"), 60).alias("cleaned")),
    f"SELECT resp_id, {d_safe('body', 60)} AS cleaned FROM ({sd.RESPONSES})",
)
TARGETS = (
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://user:Passw0rd@') || '?key=SECRET#frag' WHEN 1 THEN url WHEN 2 THEN 'ftp://u:passw@h/' || CAST(page_id AS STRING)"
    " ELSE 'https://u@/x' END AS target FROM pages"
)
register(
    "safe_target",
    lambda s, sf: view(s, sf, TARGETS).select("page_id", tx.safe_target(F.col("target")).alias("target")),
    f"""WITH p AS (SELECT page_id, target, lower(regexp_extract(target, '^(.*?)://', 1)) AS scheme, regexp_extract(target, '^.*?://(.*)$', 1) AS rest FROM ({TARGETS})),
    u AS (SELECT *, string_split(split_part(rest, '/', 1), '@')[-1] AS hp, regexp_extract(rest, '^[^/]*([^?#]*)', 1) AS path FROM p)
    SELECT page_id, CASE WHEN scheme NOT IN ('http', 'https') THEN {d_safe('target', 300)} WHEN hp = '' THEN '<redacted-target>' ELSE {d_safe("scheme || '://' || hp || path", 500)} END AS target FROM u""",
)
FENCED = (
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'intro' || chr(10) || '  ```py' || chr(10) || html || chr(10) || '```' || chr(13) || chr(10) || 'end' WHEN 1 THEN 'a' || chr(10) || '```' || chr(10) || html"
    " ELSE html || chr(10) END AS text FROM pages"
)
register(
    "code_fence_strip",
    lambda s, sf: view(s, sf, FENCED).select("page_id", F.sha2(tx.code_fence_strip(F.col("text")), 256).alias("digest")),
    f"""WITH l AS (SELECT page_id, i, len(a) AS n, a[i] AS line, regexp_matches(a[i], '^\\s*```') AS fence FROM (SELECT page_id, string_split(text, chr(10)) AS a, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM ({FENCED}))),
    f AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY page_id ORDER BY i) AS c FROM l)
    SELECT p.page_id, sha256(coalesce(t, '')) AS digest FROM pages p LEFT JOIN (SELECT page_id, string_agg(line || CASE WHEN i < n THEN chr(10) ELSE '' END, '' ORDER BY i) AS t FROM f WHERE NOT fence AND c % 2 = 0 GROUP BY page_id) x USING (page_id)""",
)
register(
    "shannon_entropy",
    lambda s, sf: table(s, sf, "conversations").select("conv_id", "turn", F.round(shannon_bits(F.col("text")), 6).alias("bits")),
    f"SELECT conv_id, turn, round({D_BITS}, 6) AS bits FROM (SELECT conv_id, turn, text AS tok FROM conversations)",
)
register(
    "json_escape_inside",
    lambda s, sf: table(s, sf, "pages").select("page_id", F.sha2(tx.json_escape_inside(F.col("html")), 256).alias("digest")),
    "SELECT page_id, sha256(substr(j, 2, length(j) - 2)) AS digest FROM (SELECT page_id, CAST(to_json(html) AS VARCHAR) AS j FROM pages)",
)
GATE_ROWS = (
    "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN 'Text/Event-Stream' WHEN 2 THEN 'text/html' WHEN 3 THEN 'application/x-ndjson' WHEN 4 THEN 'image/png' ELSE 'text/plain' END AS ct,"
    " CASE event_id % 4 WHEN 0 THEN 'gzip' WHEN 1 THEN ' Identity ' WHEN 2 THEN '' ELSE NULL END AS ce FROM events"
)
register(
    "response_gate",
    lambda s, sf: view(s, sf, GATE_ROWS).where(tx.response_gate(F.col("ct"), F.col("ce"))).select("event_id", "ct"),
    f"SELECT event_id, ct FROM ({GATE_ROWS}) WHERE lower(trim(coalesce(ce, ''))) IN ('', 'identity') AND (contains(lower(ct), 'application/json') OR contains(lower(ct), 'text/event-stream') OR contains(lower(ct), 'application/x-ndjson') OR contains(lower(ct), 'text/plain'))",
)

# --- JSON bodies ------------------------------------------------------------------------------------------

D_LEAVES = f"SELECT msg_id, j.fullkey AS path, j.atom ->> '$' AS value FROM (SELECT msg_id, CAST(body AS JSON) AS body FROM ({sd.BODIES})) b, json_tree(b.body) j WHERE j.type = 'VARCHAR'"
register(
    "json_string_leaves",
    lambda s, sf: jt.json_string_leaves(view(s, sf, sd.BODIES, "msg_id"), ["msg_id"]).select("msg_id", "path", "value"),
    f"SELECT msg_id, replace(path, '\"', '') AS path, value FROM ({D_LEAVES})",
)
register(
    "json_leaves",
    lambda s, sf: view(s, sf, sd.BODIES, "msg_id").select("msg_id", F.explode(jt.json_leaves(F.col("body"))).alias("value")),
    f"SELECT msg_id, value FROM ({D_LEAVES})",
)
D_PLAIN = f"SELECT msg_id AS id, plain AS text FROM ({sd.BODIES})"
register(
    "redact_json",
    lambda s, sf: jt.redact_json(view(s, sf, sd.BODIES, "msg_id"), dt.scan, _label).select("msg_id", "redacted", F.size("hits").cast("bigint").alias("hits")),
    f"""WITH RECURSIVE {d_scan('h', D_PLAIN)}, {d_splice('r', D_PLAIN, LABEL_SQL)}
    SELECT b.msg_id, replace(b.body, '"content":"' || b.plain, '"content":"' || r.out) AS redacted, (SELECT count(*) FROM h WHERE h.id = b.msg_id) AS hits
    FROM ({sd.BODIES}) b JOIN r ON r.id = b.msg_id""",
)
register(
    "tool_result_texts",
    lambda s, sf: jt.tool_result_texts(view(s, sf, sd.TOOL_BODIES, "msg_id"), ["msg_id"]).select("msg_id", "slot", "text"),
    f"""WITH b AS (SELECT msg_id, CAST(CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS JSON) AS j FROM ({sd.TOOL_BODIES})),
    m AS (SELECT msg_id, CAST(i AS BIGINT) AS i, j -> ('$.messages[' || i || ']') AS m FROM (SELECT msg_id, j, unnest(range(0, CAST(coalesce(json_array_length(j, '$.messages'), 0) AS BIGINT))) AS i FROM b)),
    c AS (SELECT msg_id, 'tool#' || i AS slot, m -> '$.content' AS c FROM m WHERE m ->> '$.role' IN ('tool', 'function')
      UNION ALL SELECT msg_id, 'tool_result#' || i, m -> ('$.content[' || k || '].content') FROM (SELECT *, unnest(range(0, CAST(json_array_length(m, '$.content') AS BIGINT))) AS k FROM m WHERE m ->> '$.role' = 'user' AND json_type(m, '$.content') = 'ARRAY')
      WHERE m ->> ('$.content[' || k || '].type') = 'tool_result'),
    g AS (SELECT msg_id, 'functionResponse[' || (j ->> '$.contents[0].parts[0].functionResponse.name') || ']#0' AS slot, CAST(j -> '$.contents[0].parts[0].functionResponse.response' AS VARCHAR) AS text FROM b WHERE json_exists(j, '$.contents'))
    SELECT msg_id, slot, c ->> '$' AS text FROM c WHERE json_type(c) = 'VARCHAR'
    UNION ALL SELECT msg_id, slot, c ->> ('$[' || k || '].text') FROM (SELECT *, unnest(range(0, CAST(json_array_length(c) AS BIGINT))) AS k FROM c WHERE json_type(c) = 'ARRAY')
    UNION ALL SELECT * FROM g""",
)

# --- policy ---------------------------------------------------------------------------------------------------

BLOCK = (
    "SELECT n_nationkey AS pos, CAST(n_nationkey AS STRING) AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'domain' ELSE 'process' END AS kind,"
    " CASE n_nationkey % 6 WHEN 0 THEN 'deepseek.com' WHEN 1 THEN 'chat.exe' WHEN 2 THEN 'Relay' || CAST(n_nationkey % 7 AS STRING) || '.example.com' WHEN 3 THEN 'C:' || chr(92) || 'tools' WHEN 4 THEN 'moonshot.cn' ELSE '/usr/bin/' END AS pattern,"
    " CASE WHEN n_nationkey % 5 = 0 THEN 'block' ELSE 'mask' END AS action FROM nation"
)
ALLOW = (
    "SELECT n_nationkey AS pos, CAST(n_nationkey AS STRING) AS id, CASE WHEN n_nationkey % 2 = 1 THEN 'domain' ELSE 'process' END AS kind,"
    " CASE n_nationkey % 6 WHEN 0 THEN 'code.exe' WHEN 1 THEN 'anthropic.com' WHEN 2 THEN '/opt/app' WHEN 3 THEN 'chatgpt.com' WHEN 4 THEN 'd:/work/' ELSE 'relay' || CAST(n_nationkey % 7 AS STRING) || '.example.com' END AS pattern,"
    " n_nationkey = 12 AS scrub FROM nation"
)


def d_domain(entries):
    return (
        f"SELECT DISTINCT r.host, e.* FROM (SELECT DISTINCT host, {d_host('host')} AS h FROM ({sd.REQUESTS})) r JOIN ({entries}) e ON e.kind = 'domain'"
        " AND (r.h = lower(trim(e.pattern)) OR ends_with(r.h, '.' || lower(trim(e.pattern))))"
    )


def d_process(entries):
    return (
        f"SELECT DISTINCT r.exe, e.* FROM (SELECT DISTINCT exe, lower(trim(exe)) AS x FROM ({sd.REQUESTS})) r JOIN (SELECT *, rtrim(lower(trim(pattern)), '/' || chr(92)) AS p FROM ({entries})) e ON e.kind = 'process'"
        " AND (x = p OR starts_with(x, p || chr(92)) OR starts_with(x, p || '/') OR (NOT contains(p, chr(92)) AND NOT contains(p, '/') AND ends_with(x, chr(92) || p)))"
    )


D_BLOCKED = f"""bd AS (SELECT host, arg_min(action, pos) AS a FROM ({d_domain(BLOCK)}) GROUP BY host),
bp AS (SELECT DISTINCT exe, (SELECT arg_min(action, pos) FROM ({BLOCK}) WHERE kind = 'process') AS a FROM ({d_process(BLOCK)})),
blocked AS (SELECT r.*, coalesce(bd.a, bp.a) AS block_action FROM ({sd.REQUESTS}) r LEFT JOIN bd USING (host) LEFT JOIN bp USING (exe))"""
D_ALLOWED = f"""ks AS (SELECT kind, bool_or(scrub) AS s FROM ({ALLOW}) GROUP BY kind),
ad AS (SELECT DISTINCT host, (SELECT s FROM ks WHERE kind = 'domain') AS s FROM ({d_domain(ALLOW)})),
ap AS (SELECT DISTINCT exe, (SELECT s FROM ks WHERE kind = 'process') AS s FROM ({d_process(ALLOW)})),
allowed AS (SELECT r.*, ad.s IS NOT NULL OR ap.s IS NOT NULL AS allowed, coalesce(ad.s, false) OR coalesce(ap.s, false) OR (ad.s IS NULL AND ap.s IS NULL) AS allow_scrub
  FROM blocked r LEFT JOIN ad USING (host) LEFT JOIN ap USING (exe))"""


def blocked(s, sf):
    return pl.blocklist_match(view(s, sf, sd.REQUESTS, "req_id"), view(s, sf, BLOCK))


def decided(s, sf):
    df = pl.allowlist_match(blocked(s, sf), view(s, sf, ALLOW))
    rules = dt.preset_rules("aggressive")
    scanned = jt.redact_json(df, lambda leaf: dt.scan(leaf, rules, None, LOCKER), _label, only=pl.needs_scan(["relay3.example.com"]))
    return pl.decide(scanned, ["relay3.example.com"])


register(
    "blocklist_match",
    lambda s, sf: blocked(s, sf).select("req_id", F.coalesce("block_action", F.lit("-")).alias("block_action")),
    f"WITH {D_BLOCKED} SELECT req_id, coalesce(block_action, '-') AS block_action FROM blocked",
)
register(
    "allowlist_match",
    lambda s, sf: pl.allowlist_match(view(s, sf, sd.REQUESTS), view(s, sf, ALLOW)).select("req_id", "allowed", "allow_scrub"),
    f"WITH {D_BLOCKED}, {D_ALLOWED} SELECT req_id, allowed, allow_scrub FROM allowed",
)
# The bodies have at most two hits, which never overlap, so the facts can be listed per template.
D_FACTS = """CASE WHEN contains(body, '5555555555554444') THEN 'BANKCARD,BANKCARD' WHEN contains(body, '4111111111111111') THEN 'BANKCARD' WHEN contains(body, 'call 138') THEN 'PHONE'
  WHEN contains(body, 's3cret') AND NOT contains(body, 'value-4') THEN 'LOCKER' WHEN contains(body, 'AKIA') THEN 'APIKEY' ELSE '' END"""
D_DECIDED = f"""{D_BLOCKED}, {D_ALLOWED},
facts AS (SELECT *, {D_FACTS} AS tags, {d_class('host')} AS host_class, contains(content_type, 'application/json') AND json_valid(body) AS js FROM allowed),
gate AS (SELECT *, tags IN ('BANKCARD,BANKCARD', 'APIKEY') OR (tags = 'LOCKER' AND contains(body, 'value-0')) AS gated, block_action IS NOT NULL AS forced FROM facts),
decided AS (SELECT *, CASE WHEN host_class = 'none' THEN 'pass' WHEN host_class = 'suffix' THEN 'passthrough' WHEN coalesce(block_action, '') = 'block' THEN 'block'
  WHEN NOT forced AND allowed AND NOT allow_scrub THEN 'passthrough' WHEN NOT js THEN 'passthrough'
  WHEN NOT forced AND NOT allowed AND gated THEN 'block' WHEN tags = '' THEN 'passthrough' ELSE 'mask' END AS decision FROM gate)"""
register(
    "decide",
    lambda s, sf: plain(decided(s, sf).select("req_id", "host_class", "decision", "kinds")),
    f"""WITH {D_DECIDED} SELECT req_id, host_class, decision, CASE WHEN host_class <> 'exact' THEN '' WHEN coalesce(block_action, '') = 'block' THEN 'BLACKLIST'
    WHEN NOT js OR tags = '' OR (NOT forced AND allowed AND NOT allow_scrub) THEN '' WHEN forced THEN tags || ',BLACKLIST' ELSE tags END AS kinds FROM decided""",
)
register(
    "passthrough_credentials",
    lambda s, sf: pl.passthrough_credentials(decided(s, sf), LOCKER, ["req_id"]),
    f"WITH {D_DECIDED} SELECT req_id, 'cred' || regexp_extract(body, 'value-([0-9])', 1) AS entry FROM decided WHERE decision = 'passthrough' AND allowed AND NOT allow_scrub AND regexp_matches(body, 's3cret-value-[0-3]')",
)
register(
    "hit_summary",
    lambda s, sf: plain(pl.hit_summary(dt.with_hits(view(s, sf, sd.REQUESTS), dt.preset_rules("aggressive"), locker=LOCKER), ["req_id"])),
    f"""SELECT req_id, tags AS kinds, CASE WHEN contains(tags, 'BANKCARD') THEN 'builtin.bankcard' WHEN tags = 'PHONE' THEN 'builtin.phone' WHEN tags = 'APIKEY' THEN 'builtin.apikey' ELSE '' END AS rule_ids,
    CASE WHEN tags = 'LOCKER' THEN 'cred' || regexp_extract(body, 'value-([0-9])', 1) ELSE '' END AS locker_entries,
    CAST(CASE WHEN tags = '' THEN 0 WHEN contains(tags, ',') THEN 2 ELSE 1 END AS BIGINT) AS hits FROM (SELECT req_id, body, {D_FACTS} AS tags FROM ({sd.REQUESTS}))""",
)
