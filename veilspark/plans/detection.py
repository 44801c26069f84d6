"""Registered queries: span kernel, detectors, redaction, gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.operators import detect as dt
from veilspark.operators import semantic as sm
from veilspark.operators.locker import LockerEntry, locker_clean, locker_entry_names, locker_matchers
from veilspark.operators.redact import redact
from veilspark.plans import seeded as sd
from veilspark.sources.messages import spread
from veilspark.plans.base import (
    DEFAULT_TAGS, RULE_WHERE, RULES, d_rule, d_scan, d_spans, d_splice, plain, q, table, view,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}
DOCS = "SELECT doc_id AS id, text FROM documents"
SEEDS = f"SELECT msg_id AS id, body AS text FROM ({sd.MESSAGES})"
RULE = {r.tag: r for r in dt.builtin_rules()}
FOUND = "SELECT id AS {key}, start, len, '{tag}' AS tag FROM h"


def docs(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("text").alias("body")), "doc_id")


def msgs(spark, sf):
    return view(spark, sf, sd.MESSAGES, "msg_id")


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


# --- rules on whole corpora -------------------------------------------------------------------------

register(
    "regex_spans",
    lambda s, sf: plain(dt.regex_spans(docs(s, sf), r"[0-9]+", ["doc_id"])),
    f"WITH {d_spans('h', DOCS, '[0-9]+')} SELECT id AS doc_id, start, len, tok AS text FROM h",
)
register(
    "digit_adjacent",
    lambda s, sf: plain(
        dt.regex_spans(msgs(s, sf), r"1[3-9]\d{9}", ["msg_id"]).select("msg_id", "start", F.lit("raw").alias("kind"))
        .unionByName(dt.detect(msgs(s, sf), RULE["PHONE"], ["msg_id"]).select("msg_id", "start", F.lit("kept").alias("kind")))
    ),
    f"WITH {d_spans('a', SEEDS, RULES['PHONE'][1])}, {d_rule('h', SEEDS, 'PHONE')} "
    "SELECT id AS msg_id, start, 'raw' AS kind FROM a UNION ALL SELECT id, start, 'kept' FROM h",
)


def _rule_query(tag, corpus):
    key = "doc_id" if corpus == "docs" else "msg_id"
    src = {"docs": docs, "seeds": msgs}[corpus]

    def fn(s, sf):
        return plain(dt.detect(src(s, sf), RULE[tag], [key]).select(key, "start", "len", "tag"))

    sql = f"WITH {d_rule('h', DOCS if corpus == 'docs' else SEEDS, tag)} " + FOUND.format(key=key, tag=tag)
    return fn, sql


for _tag, _name in (("IDCARD", "idcard"), ("PHONE", "phone"), ("BANKCARD", "bankcard"), ("EMAIL", "email"),
                    ("APIKEY", "apikey"), ("IP", "ipv4")):
    register(f"detect_{_name}", *_rule_query(_tag, "seeds"))
    if _tag in ("BANKCARD", "EMAIL", "IP"):
        register(f"detect_{_name}_documents", *_rule_query(_tag, "docs"))

PAGES = "SELECT page_id AS id, html AS text FROM pages"
register(
    "detect_email_pages",
    lambda s, sf: plain(
        dt.detect(spread(table(s, sf, "pages").select("page_id", F.col("html").alias("body")), "page_id"), RULE["EMAIL"], ["page_id"])
        .select("page_id", "start", "len", "tag")
    ),
    f"WITH {d_rule('h', PAGES, 'EMAIL')} " + FOUND.format(key="page_id", tag="EMAIL"),
)

CUSTOM = dt.Rule("custom.token", "bankcard", r"4\d{15}", action="block")
TICKET = dt.Rule("custom.order", " ticket ", r"order [0-9]{1,9}")
register(
    "detect_custom",
    lambda s, sf: plain(
        dt.find_long(msgs(s, sf), dt.rule_matchers([CUSTOM, TICKET]), ["msg_id"]).select("msg_id", "start", "len", "tag", "rule_id", "min_confirm", "validated")
    ),
    f"WITH {d_spans('a', SEEDS, '4[0-9]{15}', RULE_WHERE['BANKCARD'])}, {d_spans('b', SEEDS, 'order [0-9]{1,9}')} "
    "SELECT id AS msg_id, start, len, 'BANKCARD' AS tag, 'custom.token' AS rule_id, CAST(2 AS BIGINT) AS min_confirm, true AS validated FROM a "
    "UNION ALL SELECT id, start, len, 'TICKET', 'custom.order', CAST(1 AS BIGINT), false FROM b",
)

# --- semantic detectors -------------------------------------------------------------------------------


def _semantic_query(cfg, tag, src, key, sql_body):
    def fn(s, sf):
        return plain(dt.find_long(src(s, sf), sm.semantic_matchers(cfg), [key]).select(key, "start", "len", "tag"))

    register(f"detect_{tag}", fn, sql_body)


D_BITS = (
    "list_sum(list_transform(list_distinct(string_split(tok, '')), lambda c: -((length(tok) - length(replace(tok, c, ''))) / length(tok))"
    " * log2((length(tok) - length(replace(tok, c, ''))) / length(tok))))"
)
D_ENTROPY = (
    "NOT (length(tok) = 36 AND substr(tok, 9, 1) = '-') AND (CAST(regexp_matches(tok, '[A-Z]') AS INT) + CAST(regexp_matches(tok, '[a-z]') AS INT)"
    " + CAST(regexp_matches(tok, '[0-9]') AS INT) + CAST(regexp_matches(tok, '[^A-Za-z0-9]') AS INT)) >= 3"
    f" AND NOT regexp_full_match(tok, '[0-9A-Fa-f]+') AND {D_BITS} >= 3.3"
)
_semantic_query(sm.SemanticConfig(entropy=True, address=False), "entropy", msgs, "msg_id",
                f"WITH {d_spans('h', SEEDS, fx.ENTROPY_TOKEN, D_ENTROPY)} " + FOUND.format(key="msg_id", tag="HIGH_ENTROPY"))


def _in(words):
    return "(" + ", ".join(q(w) for w in words) + ")"


def _alt(words):
    return "(?:" + "|".join(words) + ")"


D_PERSON = (
    f"tok NOT IN {_in(fx.PERSON_BLOCKLIST + fx.REGIONS)} AND (regexp_matches(substr(text, start + len + 1, 3), {q('^' + _alt(fx.TITLES_AFTER))})"
    f" OR regexp_matches(substr(text, greatest(start - 7, 1), least(start, 8)), {q(_alt(fx.CONTEXT_BEFORE))}))"
)
_semantic_query(sm.SemanticConfig(person=True, address=False), "person", msgs, "msg_id",
                f"WITH {d_spans('h', SEEDS, sm.PERSON_PATTERN, D_PERSON)} " + FOUND.format(key="msg_id", tag="PERSON"))
D_CORE = f"regexp_replace(regexp_replace(tok, {q(_alt(fx.ORG_SUFFIXES) + '$')}, ''), {q('^[' + fx.ORG_LEADING + ']+')}, '')"
D_ORG = f"length({D_CORE}) >= 2 AND NOT regexp_matches({D_CORE}, {q(_alt(fx.ORG_BLOCKLIST))}) AND NOT regexp_full_match({D_CORE}, '[0-9]+')"
_semantic_query(sm.SemanticConfig(org=True, address=False), "org", msgs, "msg_id",
                f"WITH {d_spans('h', SEEDS, sm.ORG_PATTERN, D_ORG)} " + FOUND.format(key="msg_id", tag="ORG"))
D_AREA = f"NOT contains('{fx.AREA_BAD_NEXT}', next) AND tok NOT LIKE '%区间' OR next = '' AND tok NOT LIKE '%区间'"
_semantic_query(
    sm.SemanticConfig(), "address", msgs, "msg_id",
    f"WITH {d_spans('h', SEEDS, sm.AREA_PATTERN, D_AREA)}, {d_spans('h2', SEEDS, fx.STREET_PATTERN)} "
    + FOUND.format(key="msg_id", tag="ADDRESS") + " UNION ALL SELECT id, start, len, 'ADDRESS' FROM h2",
)
TERMS = ("星舰计划", "atlas", " Atlas ", "")
D_WORD = "NOT regexp_matches(prev, '[A-Za-z0-9]') AND NOT regexp_matches(next, '[A-Za-z0-9]')"
_semantic_query(
    sm.SemanticConfig(address=False, terms=TERMS), "terms", msgs, "msg_id",
    f"WITH {d_spans('h', SEEDS, '(?i)atlas', D_WORD)}, {d_spans('h2', SEEDS, '星舰计划')} "
    + FOUND.format(key="msg_id", tag="CUSTOM_TERM") + " UNION ALL SELECT id, start, len, 'CUSTOM_TERM' FROM h2",
)

# --- locker -------------------------------------------------------------------------------------------

LOCKER = [LockerEntry(f"cred{i}", f"s3cret-value-{i}", "block" if i == 0 else "mask") for i in range(4)] + [
    LockerEntry("off", "plain prose", enabled=False), LockerEntry("k8s", "/etc/secret.pem", kind="path"),
    LockerEntry("greet", "nothing in it"), LockerEntry("greet", "order 1", "block"),
]
D_LOCKER_ROWS = ", ".join(
    f"({i}, {q(e.name)}, {q(e.value)}, '{e.action}')" for i, e in enumerate(e for e in LOCKER if e.enabled and e.kind == "value")
)
D_LOCKER = (
    f"lk AS (SELECT * FROM (VALUES {D_LOCKER_ROWS}) v(pri, name, value, action)),"
    f"lh AS (SELECT s.id, s.text, lk.*, CAST(unnest(list_filter(range(0, length(s.text)), lambda i: substr(s.text, CAST(i + 1 AS INT), length(lk.value)) = lk.value)) AS BIGINT) AS start,"
    f" CAST(length(lk.value) AS BIGINT) AS len FROM ({SEEDS}) s JOIN lk ON contains(s.text, lk.value))"
)
register(
    "detect_locker_values",
    lambda s, sf: plain(
        dt.find_long(msgs(s, sf), locker_matchers(LOCKER), ["msg_id"]).select("msg_id", "start", "len", "action", "locker_entry")
    ),
    f"WITH {D_LOCKER} SELECT id AS msg_id, start, len, action, name AS locker_entry FROM lh",
)
register(
    "locker_entry_names",
    lambda s, sf: msgs(s, sf).select("msg_id", F.explode(locker_entry_names(F.col("body"), LOCKER)).alias("entry")),
    f"WITH lk AS (SELECT name, arg_min(value, pri) AS value FROM (VALUES {D_LOCKER_ROWS}) v(pri, name, value, action) GROUP BY name) "
    f"SELECT s.id AS msg_id, name AS entry FROM ({SEEDS}) s JOIN lk ON contains(s.text, lk.value)",
)
LOCKER_TABLE = (
    "SELECT c_custkey AS pos, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE ' key' || CAST(c_custkey % 90 AS STRING) END AS name,"
    " CASE c_custkey % 4 WHEN 0 THEN 'short' WHEN 1 THEN ' ' || c_name || ' ' WHEN 2 THEN 'D:' || chr(92) || 'secrets' || chr(92) || c_name ELSE repeat(c_name, 300) END AS value,"
    " CASE WHEN c_custkey % 3 = 0 THEN 'block' ELSE 'warn' END AS action, true AS enabled,"
    " CASE WHEN c_custkey % 4 = 2 THEN 'path' ELSE 'other' END AS kind FROM customer"
)
register(
    "locker_clean",
    lambda s, sf: plain(
        locker_clean(view(s, sf, LOCKER_TABLE)).select("pos", "name", F.length("value").alias("chars"), F.sha2("value", 256).alias("digest"), "action", "kind")
    ),
    f"""WITH t AS (SELECT pos, trim(name) AS name, trim(value) AS value, action, kind = 'path' AS is_path FROM ({LOCKER_TABLE})),
    u AS (SELECT pos, CASE WHEN name = '' AND is_path THEN regexp_extract(value, '[^/\\\\]+$') ELSE name END AS name,
      value, action, is_path
      FROM t WHERE length(value) >= CASE WHEN is_path THEN 2 ELSE 8 END),
    f AS (SELECT name, min(pos) AS pos FROM u WHERE name <> '' GROUP BY name)
    SELECT u.pos, u.name, CAST(length(value) AS BIGINT) AS chars, sha256(value) AS digest,
      CASE WHEN NOT is_path AND action = 'block' THEN 'block' ELSE 'mask' END AS action, CASE WHEN is_path THEN 'path' ELSE 'value' END AS kind
    FROM u JOIN f USING (name, pos)""",
)

# --- all sources, overlaps, redaction ---------------------------------------------------------------------

FULL = sm.SemanticConfig(entropy=True, person=True, org=True, address=True, terms=TERMS)
register(
    "resolve_overlaps",
    lambda s, sf: plain(
        dt.hits_long(dt.with_hits(msgs(s, sf), dt.preset_rules("aggressive")), ["msg_id"]).select("msg_id", "start", "len", "tag", "action", "min_confirm")
    ),
    f"WITH RECURSIVE {d_scan('h', SEEDS, list(RULES))} SELECT id AS msg_id, start, len, tag,"
    " CASE WHEN tag IN ('IDCARD', 'BANKCARD', 'APIKEY') THEN 'block' ELSE 'mask' END AS action,"
    " CAST(CASE WHEN tag IN ('IDCARD', 'BANKCARD') THEN 2 ELSE 1 END AS BIGINT) AS min_confirm FROM h",
)
register(
    "hits_long",
    lambda s, sf: plain(dt.hits_long(dt.with_hits(docs(s, sf)), ["doc_id"]).select("doc_id", "start", "len", "tag", "rule_id")),
    f"WITH RECURSIVE {d_scan('h', DOCS)} SELECT id AS doc_id, start, len, tag, rule_id FROM h",
)
_SEM = (
    f"{d_spans('se', SEEDS, fx.ENTROPY_TOKEN, D_ENTROPY)}, {d_spans('sp', SEEDS, sm.PERSON_PATTERN, D_PERSON)},"
    f"{d_spans('so', SEEDS, sm.ORG_PATTERN, D_ORG)}, {d_spans('sa', SEEDS, sm.AREA_PATTERN, D_AREA)},"
    f"{d_spans('st', SEEDS, fx.STREET_PATTERN)}, {d_spans('t1', SEEDS, '星舰计划')}, {d_spans('t2', SEEDS, '(?i)atlas', D_WORD)}, {D_LOCKER}"
)
_SEM_UNION = "".join(
    f" UNION ALL SELECT id, text, tok, start, len, {10000 + p} AS pri, '{t}' AS tag, '' AS rule_id FROM {n}"
    for n, p, t in (("se", 0, "HIGH_ENTROPY"), ("sp", 1, "PERSON"), ("so", 2, "ORG"), ("sa", 3, "ADDRESS"), ("st", 4, "ADDRESS"),
                    ("t1", 10, "CUSTOM_TERM"), ("t2", 11, "CUSTOM_TERM"))
) + " UNION ALL SELECT id, text, value AS tok, start, len, 20000 + pri, 'LOCKER', 'locker' FROM lh"
register(
    "scan_all",
    lambda s, sf: plain(
        dt.hits_long(dt.with_hits(msgs(s, sf), None, FULL, LOCKER), ["msg_id"]).select("msg_id", "start", "len", "tag", "rule_id")
    ),
    f"WITH RECURSIVE {_SEM}, {d_scan('h', SEEDS, None, _SEM_UNION)} SELECT id AS msg_id, start, len, tag, rule_id FROM h",
)


LABEL_SQL = "SELECT id, start, len, '<' || tag || ':' || len || '>' AS repl FROM h"


def _label(h):
    return F.concat(F.lit("<"), h["tag"], F.lit(":"), h["len"].cast("string"), F.lit(">"))


register(
    "redact",
    lambda s, sf: redact(dt.with_hits(docs(s, sf)), _label).select("doc_id", "redacted"),
    f"WITH RECURSIVE {d_scan('h', DOCS)}, {d_splice('r', DOCS, LABEL_SQL)} "
    "SELECT id AS doc_id, out AS redacted FROM r",
)


def flagship(s, sf):
    """Hits per source, language and tag, with the number of documents and of redacted characters."""
    scanned = dt.with_hits(docs(s, sf), dt.preset_rules("aggressive"))
    return (
        scanned.where(F.size("hits") > 0)
        .select("source", "lang", "doc_id", F.explode("hits").alias("h"))
        .groupBy("source", "lang", F.col("h.tag").alias("tag"))
        .agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("documents"), F.sum("h.len").alias("chars"))
    )


register(
    "hits_by_source",
    flagship,
    f"WITH RECURSIVE {d_scan('h', DOCS, list(RULES))} SELECT d.source, d.lang, h.tag, count(*) AS hits, count(DISTINCT d.doc_id) AS documents,"
    " CAST(sum(h.len) AS BIGINT) AS chars FROM h JOIN documents d ON d.doc_id = h.id GROUP BY ALL",
)
DRY = {"digits": "[0-9]+", "words": "[A-Za-z]{12,}", "none": "zzzqqq"}
register(
    "rule_dry_run",
    lambda s, sf: dt.rule_dry_run(docs(s, sf), DRY),
    " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (c > 0) AS messages, CAST(coalesce(sum(c), 0) AS BIGINT) AS matches"
        f" FROM (SELECT len(regexp_extract_all(text, {q(p)})) AS c FROM documents)"
        for n, p in DRY.items()
    ),
)
def samples(s, sf):
    found = dt.rule_samples(docs(s, sf), DRY, "doc_id", 5)
    shown = F.array_join(F.transform("samples", lambda x: F.concat_ws("/", x["key"].cast("string"), x["start"].cast("string"), x["len"].cast("string"))), ",")
    return found.select("rule", "messages", "matches", shown.alias("samples"))


D_HITS = ", ".join(d_spans(f"y{i}", DOCS, p) for i, p in enumerate(DRY.values()))
register(
    "rule_samples",
    samples,
    f"""WITH {D_HITS}, a AS ({' UNION ALL '.join(f"SELECT '{n}' AS rule, id, start, len, md5('{n}:' || id || ':' || start) AS h FROM y{i}" for i, n in enumerate(DRY))}),
    b AS (SELECT *, row_number() OVER (PARTITION BY rule, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 5 ORDER BY h, start, len, id) AS rn FROM a),
    c AS (SELECT rule, string_agg(id || '/' || start || '/' || len, ',' ORDER BY h) AS samples FROM b WHERE rn = 1 GROUP BY rule)
    SELECT r.rule, count(DISTINCT id) AS messages, count(id) AS matches, coalesce(max(samples), '') AS samples FROM (VALUES {', '.join(f"('{n}')" for n in DRY)}) r(rule)
    LEFT JOIN a ON a.rule = r.rule LEFT JOIN c ON c.rule = r.rule GROUP BY r.rule""",
)
D_BLOCKS = (
    "SELECT id, bool_or(n >= need) AS blocked FROM (SELECT id, rule_id, count(*) AS n, CASE WHEN rule_id = 'builtin.apikey' THEN 1 ELSE 2 END AS need"
    " FROM h3 WHERE tag IN ('IDCARD', 'BANKCARD', 'APIKEY') GROUP BY id, rule_id) GROUP BY id"
)
register(
    "preset_compare",
    lambda s, sf: dt.preset_compare(msgs(s, sf)),
    f"""WITH RECURSIVE {d_scan('h1', SEEDS, ['IDCARD', 'BANKCARD', 'APIKEY'])}, {d_scan('h2', SEEDS, DEFAULT_TAGS)}, {d_scan('h3', SEEDS, list(RULES))},
    n AS (SELECT count(*) AS n FROM ({SEEDS})), b AS ({D_BLOCKS})
    SELECT 'conservative' AS preset, (SELECT count(DISTINCT id) FROM h1) AS masked, CAST(0 AS BIGINT) AS blocked, n - (SELECT count(DISTINCT id) FROM h1) AS clean FROM n
    UNION ALL SELECT 'balanced', (SELECT count(DISTINCT id) FROM h2), 0, n - (SELECT count(DISTINCT id) FROM h2) FROM n
    UNION ALL SELECT 'aggressive', (SELECT count(DISTINCT id) FROM h3) - (SELECT count(*) FROM b WHERE blocked), (SELECT count(*) FROM b WHERE blocked),
      n - (SELECT count(DISTINCT id) FROM h3) FROM n""",
)
register(
    "block_gate",
    lambda s, sf: dt.with_hits(msgs(s, sf), dt.preset_rules("aggressive")).select("msg_id", dt.block_gate(F.col("hits")).alias("blocked")),
    f"WITH RECURSIVE {d_scan('h3', SEEDS, list(RULES))}, b AS ({D_BLOCKS}) SELECT s.id AS msg_id, coalesce(b.blocked, false) AS blocked FROM ({SEEDS}) s LEFT JOIN b ON b.id = s.id",
)
