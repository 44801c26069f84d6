"""Registered queries: log reports, sessions, time folds, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.operators import logs as lg
from veilspark.operators import probes as pb
from veilspark.plans import seeded as sd
from veilspark.plans.base import plain, view
from veilspark.plans.scalars import D_DECIDED, D_RANK, d_safe, decided

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-02-05 12:00:00'"


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def now():
    return F.expr(NOW)


def log(s, sf):
    return view(s, sf, sd.REQUEST_LOG)


def events(s, sf):
    return view(s, sf, sd.AUDIT_EVENTS)


LOG, EV = f"({sd.REQUEST_LOG})", f"({sd.AUDIT_EVENTS})"
COLS = "id, epoch_us(ts) AS ts, host, path, session, action, CAST(blocked AS BIGINT) AS blocked, user_label, rule_id"
ECOLS = "id, epoch_us(ts) AS ts, sid, host, signal_type, severity, evidence, user_label"

register(
    "log_stats",
    lambda s, sf: lg.log_stats(log(s, sf)),
    f"SELECT count(*) AS total, count(*) FILTER (action = 'mask') AS masked, count(*) FILTER (blocked = 1) AS blocked, count(DISTINCT session) AS sessions FROM {LOG}",
)
register("recent_requests", lambda s, sf: plain(lg.recent_requests(log(s, sf), 50)), f"SELECT {COLS} FROM {LOG} ORDER BY id DESC LIMIT 50")
WINDOW = ("2024-01-05 00:00:00", "2024-01-20 00:00:00")
D_PAGE = f"(blocked = 1 OR action = 'block') AND ts >= TIMESTAMP '{WINDOW[0]}' AND ts < TIMESTAMP '{WINDOW[1]}'"
register(
    "requests_page",
    lambda s, sf: plain(lg.requests_page(log(s, sf), 20, 100, "block", *WINDOW)[0]),
    f"SELECT {COLS} FROM {LOG} WHERE {D_PAGE} ORDER BY id DESC LIMIT 100 OFFSET 20",
)
register(
    "requests_page_total",
    lambda s, sf: lg.requests_page(log(s, sf), 20, 100, "block", *WINDOW)[1],
    f"SELECT count(*) AS total FROM {LOG} WHERE {D_PAGE}",
)
register(
    "requests_after",
    lambda s, sf: plain(lg.requests_after(log(s, sf), 5000, 100, "mask")),
    f"SELECT {COLS} FROM {LOG} WHERE action = 'mask' AND id < 5000 ORDER BY id DESC LIMIT 100",
)
register(
    "audit_since",
    lambda s, sf: plain(lg.audit_since(events(s, sf), 100, 1000, "high", "error_leak")),
    f"SELECT {ECOLS} FROM {EV} WHERE id > 100 AND severity IN ('HIGH', 'CRITICAL') AND signal_type = 'error_leak' ORDER BY id DESC LIMIT 1000",
)
register("audit_recent", lambda s, sf: plain(lg.audit_recent(events(s, sf), 200)), f"SELECT {ECOLS} FROM {EV} ORDER BY id DESC LIMIT 200")
register("recent_events_ring", lambda s, sf: plain(lg.recent_events_ring(events(s, sf))), f"SELECT {ECOLS} FROM {EV} ORDER BY id DESC LIMIT 8")
D_CATALOGUE = "(VALUES " + ", ".join(f"({i}, '{n}', {str(b).lower()})" for i, (n, b) in enumerate(fx.SIGNALS)) + ") c(pos, signal, implemented)"
register(
    "signal_counts",
    lambda s, sf: plain(lg.signal_counts(events(s, sf))),
    f"SELECT CAST(pos AS BIGINT) AS pos, signal, implemented AS enabled, implemented, count(e.id) AS hits FROM {D_CATALOGUE} LEFT JOIN {EV} e ON e.signal_type = signal GROUP BY ALL",
)

def split(s, sf):
    return lg.retention_split(log(s, sf), events(s, sf), now(), {"passthrough": 10, "mask": 30, "block": 20}, 25)


D_GONE = "(action = 'passthrough' AND ts < {n} - INTERVAL 10 DAY OR action = 'mask' AND ts < {n} - INTERVAL 30 DAY OR action = 'block' AND ts < {n} - INTERVAL 20 DAY)".format(n=NOW)
register("retention_split", lambda s, sf: plain(split(s, sf)[0].select("id", "action")), f"SELECT id, action FROM {LOG} WHERE NOT {D_GONE}")
register("retention_events", lambda s, sf: plain(split(s, sf)[1].select("id", "severity")), f"SELECT id, severity FROM {EV} WHERE NOT ts < {NOW} - INTERVAL 25 DAY")
register(
    "retention_counts",
    lambda s, sf: split(s, sf)[2],
    f"SELECT part, count(id) AS removed FROM (VALUES ('passthrough'), ('mask'), ('block')) p(part) LEFT JOIN (SELECT * FROM {LOG} WHERE {D_GONE}) l ON l.action = part GROUP BY part"
    f" UNION ALL SELECT 'total', count(*) FROM {LOG} WHERE {D_GONE} UNION ALL SELECT 'audit', count(*) FROM {EV} WHERE ts < {NOW} - INTERVAL 25 DAY",
)
register("clear_by_action", lambda s, sf: plain(lg.clear_by_action(log(s, sf), "block").select("id", "action")), f"SELECT id, action FROM {LOG} WHERE NOT (blocked = 1 OR action = 'block')")
FEED = (
    "SELECT doc_id * 3 AS id, CASE WHEN toxic = 1 THEN ' fp ' WHEN quality = 1 THEN 'tn' ELSE 'bad' END AS label, doc_id AS ts FROM labels"
    " UNION ALL SELECT doc_id * 300, 'none', doc_id + 1000000 FROM labels"
)


def labelled(s, sf):
    rows = log(s, sf).select("id", "user_label", F.lit(None).cast("bigint").alias("label_ts"))
    return lg.apply_labels(rows, view(s, sf, FEED))


D_FEED = f"f AS (SELECT id, trim(label) AS label, ts FROM ({FEED})), l AS (SELECT id, arg_max(label, ts) AS label, max(ts) AS ts FROM f WHERE label IN ('fp', 'tn', 'none') GROUP BY id)"
register(
    "apply_labels",
    lambda s, sf: labelled(s, sf)[0].select("id", "user_label", F.coalesce("label_ts", F.lit(-1)).alias("label_ts")),
    f"WITH {D_FEED} SELECT r.id, coalesce(l.label, r.user_label) AS user_label, coalesce(l.ts, -1) AS label_ts FROM {LOG} r LEFT JOIN l ON l.id = r.id",
)
register(
    "apply_labels_rejects",
    lambda s, sf: labelled(s, sf)[1],
    f"WITH {D_FEED} SELECT id, label, ts, 'bad_label' AS reason FROM f WHERE label NOT IN ('fp', 'tn', 'none') UNION ALL SELECT id, label, ts, 'unknown_id' FROM f WHERE label IN ('fp', 'tn', 'none') AND id NOT IN (SELECT id FROM {LOG})",
)
D_FP = "count(*) AS hits, count(*) FILTER (user_label = 'fp') AS fp, count(*) FILTER (user_label = 'tn') AS tn"
D_IN = f"ts >= {NOW} - INTERVAL 30 DAY"
register("fp_stats_signal", lambda s, sf: lg.fp_stats_signal(events(s, sf), now()), f"SELECT signal_type AS key, {D_FP} FROM {EV} WHERE {D_IN} GROUP BY 1")
register(
    "fp_stats_rule",
    lambda s, sf: lg.fp_stats_rule(log(s, sf), now()),
    f"SELECT trim(k) AS key, {D_FP} FROM (SELECT user_label, unnest(string_split(rule_id, ',')) AS k FROM {LOG} WHERE rule_id <> '' AND {D_IN}) WHERE trim(k) <> '' GROUP BY 1",
)
register(
    "noise_ratio",
    lambda s, sf: plain(lg.noise_ratio(events(s, sf))),
    f"SELECT epoch_us(date_trunc('hour', ts)) AS hour, signal_type, count(*) AS events FROM {EV} GROUP BY 1, 2",
)
META = "SELECT 'conv:h' || CAST(user_id % 5 AS STRING) || ':' || CAST(user_id AS STRING) AS session, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'host' || CAST(event_id % 9 AS STRING) END AS host, event_type AS process, ts AS last_seen FROM events"
HELD = "SELECT 'conv:h' || CAST(c_custkey % 5 AS STRING) || ':' || CAST(c_custkey % 200 AS STRING) AS session, c_custkey AS k FROM customer"
TOUCH = "SELECT session, max(last_seen) + INTERVAL '10' SECOND AS last_touch, CASE WHEN max(process) = 'view' THEN NULL ELSE max(last_seen) END AS pinned_at FROM (" + META + ") m GROUP BY session"
AT = "TIMESTAMP '2024-01-30 23:40:00'"
register(
    "active_sessions",
    lambda s, sf: plain(lg.active_sessions(view(s, sf, META), view(s, sf, HELD), view(s, sf, TOUCH), F.expr(AT))),
    f"""WITH m AS (SELECT session, arg_max(host, last_seen) AS host, arg_max(process, last_seen) AS process, max(last_seen) AS last_seen FROM ({META}) GROUP BY session
      HAVING floor(epoch({AT})) - floor(epoch(max(last_seen))) < 1800),
    v AS (SELECT session, count(*) AS n FROM ({HELD}) GROUP BY session), t AS ({TOUCH}), j AS (SELECT coalesce(m.session, v.session) AS session, m.host, m.process, m.last_seen, v.n FROM m FULL JOIN v ON m.session = v.session)
    SELECT j.session, coalesce(nullif(host, ''), split_part(j.session, ':', 2)) AS host, coalesce(process, '') AS process, coalesce(n, 0) AS placeholders,
      CAST(coalesce(floor(epoch({AT})) - floor(epoch(coalesce(last_touch, last_seen))), 0) AS BIGINT) AS idle_secs,
      coalesce(floor(epoch({AT})) - floor(epoch(pinned_at)) < 900, false) AS pinned FROM j LEFT JOIN t ON t.session = j.session""",
)
register(
    "expired_sessions",
    lambda s, sf: lg.expired_sessions(view(s, sf, TOUCH), F.expr(AT)).select("session"),
    f"SELECT session FROM ({TOUCH}) WHERE floor(epoch({AT})) - floor(epoch(last_touch)) > 1800 AND NOT coalesce(floor(epoch({AT})) - floor(epoch(pinned_at)) < 900, false)",
)
register(
    "first_seen_clients",
    lambda s, sf: plain(lg.first_seen_clients(view(s, sf, sd.REQUESTS))),
    f"SELECT exe, epoch_us(min(ts)) AS first_ts FROM ({sd.REQUESTS}) GROUP BY exe",
)
register(
    "kind_feed",
    lambda s, sf: plain(lg.kind_feed(decided(s, sf).withColumn("session", F.col("client")))),
    f"""WITH {D_DECIDED}, k AS (SELECT *, CASE WHEN host_class <> 'exact' THEN '' WHEN coalesce(block_action, '') = 'block' THEN 'BLACKLIST'
    WHEN NOT js OR tags = '' OR (NOT forced AND allowed AND NOT allow_scrub) THEN '' WHEN forced THEN tags || ',BLACKLIST' ELSE tags END AS kinds FROM decided)
    SELECT client AS session, unnest(string_split(kinds, ',')) AS kind, host, decision AS action, epoch_us(ts) AS ts FROM k WHERE kinds <> ''""",
)
register(
    "posture_summary",
    lambda s, sf: plain(lg.posture_summary(log(s, sf), events(s, sf), view(s, sf, sd.VAULT), now())),
    f"SELECT (SELECT count(*) FROM customer) AS placeholders, (SELECT count(*) FROM {EV}) AS signal_hits, CAST(7 AS BIGINT) AS enabled_signals, CAST(2 AS BIGINT) AS pending_signals,"
    f" CAST(date_diff('day', CAST(min(ts) AS DATE), DATE '2024-02-05') + 1 AS BIGINT) AS days FROM {LOG}",
)
REGISTRATIONS = "SELECT CASE WHEN event_id % 50 = 0 THEN ' ' ELSE ' MARK_' || CAST(event_id % 700 AS STRING) END AS nonce, ts FROM events"
register(
    "markers_active",
    lambda s, sf: plain(lg.markers_active(view(s, sf, REGISTRATIONS), F.expr("TIMESTAMP '2024-01-12 08:00:00'"))),
    f"SELECT trim(nonce) AS nonce, epoch_us(max(ts)) AS ts FROM ({REGISTRATIONS}) WHERE trim(nonce) <> '' GROUP BY 1 HAVING floor(epoch(TIMESTAMP '2024-01-12 08:00:00')) - floor(epoch(max(ts))) < 3600",
)

# --- folds over time --------------------------------------------------------------------------------------------

USES = "SELECT 'c' || CAST(user_id AS STRING) AS client, CASE WHEN event_id % 3 = 0 THEN 'plaintext' ELSE 'masked' END AS path, 'cred' || CAST(event_id % 4 AS STRING) AS entry, ts FROM events"
register(
    "usage_cooldown",
    lambda s, sf: plain(lg.usage_cooldown(view(s, sf, USES), 7200)),
    f"""WITH RECURSIVE u AS (SELECT path, entry, epoch_us(ts) AS us FROM ({USES})),
    n AS (SELECT path, entry, min(us) AS us FROM u GROUP BY path, entry
      UNION ALL SELECT path, entry, us FROM (SELECT n.path, n.entry, (SELECT min(u.us) FROM u WHERE u.path = n.path AND u.entry = n.entry AND u.us >= n.us + 7200000000) AS us FROM n) WHERE us IS NOT NULL),
    m AS (SELECT *, lag(us) OVER (PARTITION BY path, entry ORDER BY us) AS prev FROM n)
    SELECT path, entry, (SELECT count(*) FROM u WHERE u.path = m.path AND u.entry = m.entry AND u.us <= m.us AND (m.prev IS NULL OR u.us > m.prev)) AS count,
      coalesce(prev, us) AS first_ts, us AS notice_ts FROM m""",
)
REPLIED = "SELECT 'c' || CAST(user_id AS STRING) AS client, ts FROM events WHERE event_type = 'view'"
STAGED = f"SELECT client, path, entry, ts FROM ({USES}) u"
register(
    "usage_ledger",
    lambda s, sf: plain(lg.usage_ledger(view(s, sf, STAGED), view(s, sf, REPLIED))),
    f"""WITH u AS (SELECT *, (SELECT min(r.ts) FROM ({REPLIED}) r WHERE r.client = s.client AND r.ts >= s.ts) AS reply FROM ({STAGED}) s),
    g AS (SELECT client, reply, path, entry, min(ts) AS ts FROM u WHERE reply IS NOT NULL GROUP BY ALL),
    p AS (SELECT *, min(ts) OVER (PARTITION BY client, reply, path) AS staged FROM g)
    SELECT client, epoch_us(reply) AS reply_ts, path, entry, epoch_us(staged) AS staged_ts FROM p WHERE epoch_us(reply) - epoch_us(staged) <= 600000000""",
)
BATCHES = "SELECT CAST(floor(event_id / 3) AS BIGINT) AS batch, ts, CASE WHEN value >= 60 THEN 'CRITICAL' WHEN value >= 30 THEN 'HIGH' ELSE 'LOW' END AS severity, event_id AS id FROM events"
register(
    "alert_throttle",
    lambda s, sf: plain(lg.alert_throttle(view(s, sf, BATCHES), gap=1800)),
    f"""WITH RECURSIVE b AS (SELECT batch, epoch_us(max(ts)) AS us, max({D_RANK.format(c='severity', u=0)}) AS top, count(*) AS n FROM ({BATCHES}) GROUP BY batch HAVING max({D_RANK.format(c='severity', u=0)}) >= 3),
    a AS (SELECT min(us) AS us FROM b UNION ALL SELECT us FROM (SELECT (SELECT min(b.us) FROM b WHERE b.us >= a.us + 1800000000) AS us FROM a) WHERE us IS NOT NULL)
    SELECT arg_min(batch, batch) AS batch, b.us AS ts, CAST(arg_min(top, batch) AS BIGINT) AS top, arg_min(n, batch) AS events FROM a JOIN b USING (us) GROUP BY b.us""",
)
RESP = "SELECT 'u' || CAST(user_id AS STRING) AS client, ts, event_id AS resp_id FROM events WHERE event_type IN ('view', 'error')"
REQ = "SELECT 'u' || CAST(user_id AS STRING) AS client, ts, event_id AS req_id FROM events WHERE event_type NOT IN ('view', 'error')"
register(
    "request_for_response",
    lambda s, sf: lg.request_for_response(view(s, sf, RESP), view(s, sf, REQ), 14400).select("client", "resp_id", F.coalesce("req_id", F.lit(-1)).alias("req_id")),
    f"""SELECT p.client, p.resp_id, coalesce(CASE WHEN epoch_us(p.ts) - epoch_us(r.ts) < 14400000000 THEN r.req_id END, -1) AS req_id
    FROM ({RESP}) p ASOF LEFT JOIN ({REQ}) r ON p.client = r.client AND p.ts >= r.ts""",
)

# --- probes ---------------------------------------------------------------------------------------------------------

D_OK = "coalesce(status > 0 AND (step = 'step9_error' OR status < 400), false)"
register(
    "valid_receipts",
    lambda s, sf: pb.valid_receipts(view(s, sf, sd.PLAN).join(view(s, sf, sd.RECEIPTS), ["scan_id", "probe_id"])).select("probe_id", "step", "valid"),
    f"SELECT p.probe_id, step, {D_OK} AS valid FROM ({sd.PLAN}) p JOIN ({sd.RECEIPTS}) r USING (scan_id, probe_id)",
)


def steps(s, sf):
    return pb.step_findings(view(s, sf, sd.PLAN), view(s, sf, sd.RECEIPTS), view(s, sf, sd.FINDINGS))


D_STEPS = f"""st AS (SELECT p.scan_id, p.step, p.probe_id, {D_OK} AS covered FROM ({sd.PLAN}) p LEFT JOIN ({sd.RECEIPTS}) r USING (scan_id, probe_id)),
sf AS (SELECT st.*, CASE WHEN covered THEN f.signal END AS signal, CASE WHEN covered THEN f.severity END AS severity, CASE WHEN covered THEN f.evidence END AS evidence
  FROM st LEFT JOIN ({sd.FINDINGS}) f USING (scan_id, probe_id))"""
register(
    "step_findings",
    lambda s, sf: steps(s, sf).select("scan_id", "step", "covered", F.coalesce("signal", F.lit("-")).alias("signal"), F.coalesce("severity", F.lit("-")).alias("severity")),
    f"WITH {D_STEPS} SELECT scan_id, step, covered, coalesce(signal, '-') AS signal, coalesce(severity, '-') AS severity FROM sf",
)


def d_any(step, cond):
    return f"coalesce(bool_or(step = '{step}' AND covered AND severity IS NOT NULL AND ({cond})), false)"


def d_cov(step):
    return f"coalesce(bool_or(step = '{step}' AND covered), false)"


R = D_RANK.format(c="severity", u=1)
D_MATRIX = f"""{D_STEPS},
m0 AS (SELECT scan_id, {d_any('step3_verify', "signal = 'cross_request_pollution'")} AS echo, {d_cov('step3_verify')} AS c1,
  {d_any('step8_toolcall', f"signal = 'tool_call_rewrite' AND {R} >= 2")} AS replay, {d_cov('step8_toolcall')} AS c2,
  {d_any('step9_error', f'{R} >= 3')} AS leak, {d_any('step9_error', f'{R} = 2')} AS lm, {d_cov('step9_error')} AS c3,
  {d_any('step10_stream', f"signal = 'sse_anomaly' AND {R} >= 2")} AS flow, {d_cov('step10_stream')} AS c4,
  {d_any('step11_web3', f'{R} >= 2')} AS induce, {d_cov('step11_web3')} AS c5,
  coalesce(max(CASE WHEN covered AND severity IS NOT NULL THEN {R} END), 1) AS worst, count(DISTINCT step) AS e, count(DISTINCT CASE WHEN covered THEN step END) AS n FROM sf GROUP BY scan_id),
mx AS (SELECT *, NOT leak AND lm AS leak_mid, n < e AS incomplete FROM m0)"""
register(
    "risk_matrix",
    lambda s, sf: plain(pb.risk_matrix(steps(s, sf))),
    f"""WITH {D_MATRIX} SELECT scan_id, echo, c1 AND NOT echo AS echo_ok, replay, c2 AND NOT replay AS replay_ok, leak, leak_mid, c3 AND NOT leak AND NOT leak_mid AS leak_ok,
    flow, c4 AND NOT flow AS flow_ok, induce, c5 AND NOT induce AS induce_ok, CAST(worst AS BIGINT) AS worst, n || '/' || e AS coverage, incomplete FROM mx""",
)
register(
    "risk_verdict",
    lambda s, sf: pb.risk_verdict(pb.risk_matrix(steps(s, sf))).select("scan_id", "coverage", "severity"),
    f"""WITH {D_MATRIX}, b AS (SELECT *, greatest(CASE WHEN worst = 4 THEN 4 WHEN replay OR leak OR flow OR induce OR echo THEN 3 WHEN leak_mid OR worst >= 2 THEN 2 ELSE 1 END, worst) AS r FROM mx)
    SELECT scan_id, n || '/' || e AS coverage, CASE WHEN worst < 4 AND incomplete THEN 'INCONCLUSIVE' WHEN r = 4 THEN 'CRITICAL' WHEN r = 3 THEN 'HIGH' WHEN r = 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM b""",
)
register(
    "report_rows",
    lambda s, sf: pb.report_rows(steps(s, sf)),
    f"WITH {D_STEPS} SELECT scan_id, step, severity, {d_safe('signal', 80)} AS signal, replace(replace({d_safe('evidence', 160)}, '|', chr(92) || '|'), chr(10), ' ') AS evidence FROM sf WHERE covered AND severity IS NOT NULL",
)
