"""Registered queries: vault, session redaction, restore."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.operators import detect as dt
from veilspark.operators import frames as fr
from veilspark.operators.json_restore import restore_json
from veilspark.operators import restore as rs
from veilspark.operators import vault as vt
from veilspark.plans import seeded as sd
from veilspark.plans.base import d_scan, d_spans, d_splice, view
from veilspark.plans.detection import SEEDS
from veilspark.sources.lineage import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}
SALT = "bench-salt"


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


def messages(s, sf):
    return view(s, sf, sd.MESSAGES, "msg_id").withColumn("ts", F.timestamp_seconds(F.col("seq")))


def scanned(s, sf):
    return dt.with_hits(messages(s, sf))


def minted(s, sf):
    return vt.vault_mint(vt.session_hits(scanned(s, sf)), SALT)


D_SFX = f"substr(sha256('{SALT}|' || session || '|' || tok), 1, 8)"
D_MINT = f"""{d_scan('h', SEEDS)},
sh AS (SELECT m.session, m.seq, h.* FROM h JOIN ({sd.MESSAGES}) m ON m.msg_id = h.id),
vault AS (SELECT session, tok AS original, arg_min(tag, (seq, id, start)) AS tag, {D_SFX} AS suffix FROM sh GROUP BY session, tok),
v AS (SELECT *, '[[PII:' || tag || ':' || suffix || ']]' AS placeholder FROM vault)"""

register(
    "vault_mint",
    lambda s, sf: minted(s, sf).select("session", "original", "tag", "placeholder", "suffix"),
    f"WITH RECURSIVE {D_MINT} SELECT session, original, tag, placeholder, suffix FROM v",
)
register(
    "redact_sessions",
    lambda s, sf: vt.redact_sessions(scanned(s, sf), SALT)[0].select("msg_id", "session", "redacted"),
    f"""WITH RECURSIVE {D_MINT}, {d_splice('r', SEEDS, 'SELECT sh.id, sh.start, sh.len, v.placeholder AS repl FROM sh JOIN v ON v.session = sh.session AND v.original = sh.tok')}
    SELECT m.msg_id, m.session, r.out AS redacted FROM r JOIN ({sd.MESSAGES}) m ON m.msg_id = r.id""",
)
register(
    "redact_sessions_joined",
    lambda s, sf: vt.redact_with_vault(scanned(s, sf), vt.vault_mint(vt.session_hits(scanned(s, sf)), SALT), SALT)
    .select("msg_id", "session", "redacted"),
    SQL["redact_sessions"],
)


def round_trip(s, sf):
    """Redact every session, restore the result: rows whose text came back unchanged."""
    out, vault = vt.redact_sessions(scanned(s, sf), SALT)
    # The restore reads its rows several times.
    back = rs.restore(cut(out.select("msg_id", "session", F.col("body").alias("before"), F.col("redacted").alias("body"))), vault, ["msg_id"])
    return back.groupBy("session").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("before") == F.col("restored_text")).alias("same")
    )


register(
    "redact_restore_round_trip",
    round_trip,
    f"SELECT session, count(*) AS messages, count(*) AS same FROM ({sd.MESSAGES}) GROUP BY session",
)
register(
    "placeholder_parts",
    lambda s, sf: view(s, sf, sd.VAULT).select(
        "original", vt.placeholder_tag(F.col("placeholder")).alias("tag"), vt.placeholder_suffix(F.upper("placeholder")).alias("suffix"),
        F.coalesce(vt.placeholder_suffix(F.replace("placeholder", F.lit("]]"), F.lit("z]]"))), F.lit("-")).alias("bad")),
    f"SELECT original, tag, suffix, '-' AS bad FROM ({sd.VAULT})",
)
register(
    "vault_counts",
    lambda s, sf: vt.vault_counts(view(s, sf, sd.VAULT)),
    f"SELECT session, count(*) AS placeholders FROM ({sd.VAULT}) GROUP BY session",
)
COPIES = f"SELECT 'copy' AS session, placeholder FROM ({sd.VAULT}) UNION ALL SELECT session, placeholder FROM ({sd.VAULT})"
register(
    "sessions_containing",
    lambda s, sf: vt.sessions_containing(view(s, sf, COPIES), view(s, sf, sd.VAULT)),
    COPIES,
)
KNOWN = f"SELECT 'n' || CAST(o_custkey % 25 AS STRING) AS session, 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS text FROM orders"
register(
    "known_originals",
    lambda s, sf: vt.known_originals(view(s, sf, KNOWN), view(s, sf, sd.VAULT)),
    f"SELECT k.session, k.text FROM ({KNOWN}) k WHERE EXISTS (SELECT 1 FROM ({sd.VAULT}) v WHERE v.session = k.session AND v.original = k.text)",
)
GONE = "SELECT 'n' || CAST(s_nationkey AS STRING) AS session FROM supplier WHERE s_acctbal > 5000"
register(
    "vault_purge",
    lambda s, sf: vt.vault_purge(view(s, sf, sd.VAULT), view(s, sf, GONE))[0].select("session", "placeholder"),
    f"SELECT session, placeholder FROM ({sd.VAULT}) WHERE session NOT IN ({GONE})",
)
register(
    "vault_purge_count",
    lambda s, sf: vt.vault_purge(view(s, sf, sd.VAULT), view(s, sf, GONE))[1],
    f"SELECT count(*) AS purged FROM ({sd.VAULT}) WHERE session IN ({GONE})",
)

# --- restore -----------------------------------------------------------------------------------------------

D_REPLY_SRC = f"SELECT msg_id AS id, body AS text FROM ({sd.REPLIES})"
D_VAULT = f"vault AS (SELECT * FROM ({sd.VAULT})), uq AS (SELECT suffix FROM vault GROUP BY suffix HAVING count(DISTINCT placeholder) = 1)"
PARTS = r"PII:([A-Za-z0-9_]{1,32}):([0-9a-fA-F]{8})"


def d_resolved(name, tokens):
    """CTE: tokens with the original, exact in the session or by a globally unique suffix."""
    return f"""
{name}_t AS (SELECT t.*, r.session, lower(regexp_extract(tok, '{PARTS}', 2)) AS sfx,
  '[[PII:' || upper(regexp_extract(tok, '{PARTS}', 1)) || ':' || lower(regexp_extract(tok, '{PARTS}', 2)) || ']]' AS canon
  FROM ({tokens}) t JOIN ({sd.REPLIES}) r ON r.msg_id = t.id),
{name} AS (SELECT t.*, e.original AS exact, f.original AS fallback, coalesce(e.original, f.original) AS repl FROM {name}_t t
  LEFT JOIN vault e ON e.session = t.session AND e.placeholder = t.canon
  LEFT JOIN (SELECT v.* FROM vault v JOIN uq USING (suffix)) f ON e.original IS NULL AND f.session = t.session AND f.suffix = t.sfx)"""


D_STRICT = f"""{D_VAULT}, {d_spans('st', D_REPLY_SRC, fx.STRICT_PLACEHOLDER)}, {d_resolved('sr', 'SELECT * FROM st')},
{d_splice('s1', D_REPLY_SRC, 'SELECT id, start, len, repl FROM sr WHERE repl IS NOT NULL')}"""
BARE = "replace(tok, chr(92), '')"
D_LOOSE = f"""{d_spans('lt', 'SELECT id, out AS text FROM s1', fx.LOOSE_PLACEHOLDER,
    f"NOT (starts_with({BARE}, '[[') AND ends_with({BARE}, ']]')) AND NOT regexp_matches(prev, '[A-Za-z0-9_]') AND NOT regexp_matches(next, '[A-Za-z0-9_]')")},
{d_resolved('lr', 'SELECT * FROM lt')}, {d_splice('s2', 'SELECT id, out AS text FROM s1', 'SELECT id, start, len, repl FROM lr WHERE repl IS NOT NULL')}"""
D_STATS = """st1 AS (SELECT id, count(repl) AS restored, count(*) - count(repl) AS unresolved, count(*) FILTER (repl IS NOT NULL AND (exact IS NULL OR tok <> canon)) AS degraded FROM sr GROUP BY id),
st2 AS (SELECT id, count(repl) AS restored, count(*) - count(repl) AS unresolved, count(repl) AS degraded FROM lr GROUP BY id),
stats AS (SELECT r.id, coalesce(st1.restored, 0) + coalesce(st2.restored, 0) AS restored, coalesce(st1.unresolved, 0) + coalesce(st2.unresolved, 0) AS unresolved,
  coalesce(st1.degraded, 0) + coalesce(st2.degraded, 0) AS degraded FROM s2 r LEFT JOIN st1 USING (id) LEFT JOIN st2 USING (id))"""


def restored(s, sf, loose=True):
    return rs.restore(view(s, sf, sd.REPLIES), view(s, sf, sd.VAULT), ["msg_id"], loose=loose)


register(
    "restore",
    lambda s, sf: restored(s, sf, loose=False).select("msg_id", "restored_text"),
    f"WITH {D_STRICT} SELECT id AS msg_id, out AS restored_text FROM s1",
)
register(
    "restore_loose",
    lambda s, sf: restored(s, sf).select("msg_id", "restored_text", "restored", "unresolved", "degraded"),
    f"WITH {D_STRICT}, {D_LOOSE}, {D_STATS} SELECT s2.id AS msg_id, out AS restored_text, restored, unresolved, degraded FROM s2 JOIN stats USING (id)",
)


def by_suffix(s, sf):
    tok = rs._tokens(view(s, sf, sd.REPLIES), ["msg_id"], "body", fx.STRICT_PLACEHOLDER)
    return rs.resolve_tokens(tok, rs.suffix_index(view(s, sf, sd.VAULT))).where("fallback").select("msg_id", "canonical", "original")


register(
    "restore_suffix",
    by_suffix,
    f"WITH {D_STRICT} SELECT id AS msg_id, canon AS canonical, fallback AS original FROM sr WHERE exact IS NULL AND fallback IS NOT NULL",
)
register(
    "restore_stats",
    lambda s, sf: rs.restore_stats(restored(s, sf), ["session"]),
    f"""WITH {D_STRICT}, {D_LOOSE}, {D_STATS} SELECT session, CAST(sum(restored) AS BIGINT) AS restored, CAST(sum(unresolved) AS BIGINT) AS unresolved,
    CAST(sum(degraded) AS BIGINT) AS degraded, CAST(0 AS BIGINT) AS blocked FROM stats JOIN ({sd.REPLIES}) r ON r.msg_id = stats.id GROUP BY session""",
)
# Replies cut into short pieces: strict placeholders always span pieces.
PIECES = f"""
SELECT msg_id, session, i AS seq, substr(body, CAST(1 + i * 9 AS INT), 9) AS text
FROM ({sd.REPLIES}) r JOIN (SELECT DISTINCT l_linenumber - 1 AS i FROM lineitem UNION SELECT DISTINCT l_linenumber + 6 FROM lineitem) n ON i * 9 < length(body)
"""


def restored_pieces(s, sf):
    pieces = view(s, sf, PIECES)
    out = fr.restore_pieces(pieces, view(s, sf, sd.VAULT), ["session", "msg_id"], ["seq"])
    return fr.channel_text(out.select("session", "msg_id", "piece", F.col("restored_text").alias("text")), ["msg_id"], ["piece"]).select(
        "msg_id", F.col("body").alias("restored_text"))


register(
    "restore_chunks",
    lambda s, sf: rs.restore_chunks(view(s, sf, PIECES), view(s, sf, sd.VAULT), ["msg_id"]).select("msg_id", "restored_text"),
    f"WITH {D_STRICT}, {D_LOOSE} SELECT id AS msg_id, out AS restored_text FROM s2",
)
register(
    "restore_pieces",
    restored_pieces,
    f"WITH {D_STRICT}, {D_LOOSE} SELECT id AS msg_id, out AS restored_text FROM s2",
)
register(
    "leftover_audit",
    lambda s, sf: rs.leftover_audit(view(s, sf, sd.REPLIES), view(s, sf, sd.VAULT), ["msg_id"]),
    f"WITH {D_STRICT} SELECT session, count(*) AS leftover, count(*) - count(exact) AS unknown FROM sr GROUP BY session",
)

# Replies inside JSON bodies: in a list, 30 containers deep, and as arguments that are JSON text themselves; every ninth body is broken.
QUOTED_VAULT = f"SELECT session, original || chr(34) || chr(92) AS original, tag, placeholder, suffix FROM ({sd.VAULT})"


def json_bodies(s, sf):
    """Bodies around the replies; quoting by the same functions that the oracle has."""
    q1 = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    # The bodies are costly to walk; the narrow replies come from few files.
    tasks = max(s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions")))
    rows = view(s, sf, sd.REPLIES).repartition(tasks, "msg_id").withColumn("t", q1(F.col("body")))
    plain_body = F.concat(F.lit('{"a":[1,{"text":'), "t", F.lit('}],"deep":' + '{"d":' * 30), "t", F.lit("}" * 30 + ', "n" : 2.50}'))
    sent = F.concat(F.lit('{"to":'), q1(F.concat(F.lit("see "), F.regexp_extract("body", r"\[\[PII:NAME:[0-9a-f]{8}\]\]", 0))), F.lit("}"))
    call = F.concat(F.lit('{"tool":[{"arguments":'), q1(sent), F.lit("}]}"))
    kind = F.col("msg_id") % 9
    return rows.select("msg_id", "session", F.when(kind == 0, F.concat(F.lit("{broken "), "body")).when(kind == 1, call).otherwise(plain_body).alias("body"))


D_QUOTED = D_VAULT.replace(f"({sd.VAULT})", f"({QUOTED_VAULT})")
D_Q = D_STRICT.replace(D_VAULT, D_QUOTED) + ", " + D_LOOSE
register(
    "restore_json",
    lambda s, sf: restore_json(json_bodies(s, sf), view(s, sf, QUOTED_VAULT), ["msg_id"]).select("msg_id", "form", "restored_body"),
    f"""WITH {D_Q}, b AS (SELECT s2.id AS msg_id, s2.out AS text, r.body AS sent, r.session FROM s2 JOIN ({sd.REPLIES}) r ON r.msg_id = s2.id),
    c AS (SELECT b.*, regexp_extract(sent, '\\[\\[PII:NAME:[0-9a-f]{{8}}\\]\\]', 0) AS ph FROM b),
    d AS (SELECT c.*, coalesce(v.original, f.original, ph) AS put FROM c LEFT JOIN vault v ON v.session = c.session AND v.placeholder = c.ph
      LEFT JOIN (SELECT x.* FROM vault x JOIN uq USING (suffix)) f ON v.original IS NULL AND f.session = c.session AND '[[PII:NAME:' || f.suffix || ']]' = c.ph)
    SELECT msg_id, CASE WHEN msg_id % 9 = 0 THEN 'text' ELSE 'json' END AS form, CASE msg_id % 9 WHEN 0 THEN '{{broken ' || text
      WHEN 1 THEN '{{"tool":[{{"arguments":' || CAST(to_json('{{"to":' || CAST(to_json('see ' || put) AS VARCHAR) || '}}') AS VARCHAR) || '}}]}}'
      ELSE '{{"a":[1,{{"text":' || CAST(to_json(text) AS VARCHAR) || '}}],"deep":' || repeat('{{"d":', 30) || CAST(to_json(text) AS VARCHAR) || repeat('}}', 30) || ', "n" : 2.50}}' END AS restored_body FROM d""",
)

# The vault lacks a third of the customers; a second table has them for some sessions.
THIN_VAULT = f"SELECT * FROM ({sd.VAULT}) x WHERE substr(suffix, 1, 1) NOT IN ('0', '1', '2', '3', '4')"
SECOND = f"SELECT session, placeholder, 'from elsewhere: ' || original AS original FROM ({sd.VAULT}) y WHERE substr(suffix, 1, 1) IN ('0', '1', '2') OR substr(suffix, 1, 1) = '9'"
D_THIN = (D_STRICT + ", " + D_LOOSE + ", " + D_STATS).replace(f"({sd.VAULT})", f"({THIN_VAULT})").replace(
    "coalesce(e.original, f.original) AS repl", "coalesce(e.original, f.original, z.original) AS repl").replace(
    "ON e.original IS NULL AND f.session = t.session AND f.suffix = t.sfx)", f"ON e.original IS NULL AND f.session = t.session AND f.suffix = t.sfx LEFT JOIN ({SECOND}) z ON z.session = t.session AND z.placeholder = t.canon)")
D_THIN = D_THIN.replace("repl IS NOT NULL AND (exact IS NULL OR tok <> canon)", "repl IS NOT NULL AND ((exact IS NULL AND fallback IS NOT NULL) OR tok <> canon)")
register(
    "restore_resolver",
    lambda s, sf: rs.restore(view(s, sf, sd.REPLIES), view(s, sf, THIN_VAULT), ["msg_id"], resolver=view(s, sf, SECOND)).select("msg_id", "restored_text", "restored", "unresolved", "degraded"),
    f"WITH {D_THIN} SELECT s2.id AS msg_id, out AS restored_text, restored, unresolved, degraded FROM s2 JOIN stats USING (id)",
)
