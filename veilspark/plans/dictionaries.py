"""Registered queries: terms and protected values from tables of any size, searched in the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import dictionary as dc
from veilspark.operators.detect import hits_long
from veilspark.plans.base import d_resolve, d_rule, d_spans, plain, table, view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


# Every word of the benchmark, also in upper case, and phrases that aren't words: with a blank inside, with accents, of one sign.
TERM_ROWS = """
SELECT DISTINCT CASE WHEN length(w) % 2 = 0 THEN upper(w) ELSE ' ' || w || ' ' END AS term
FROM (SELECT explode(split(text, '[^A-Za-z]+')) AS w FROM benchmark) t WHERE length(w) > 5
UNION ALL SELECT DISTINCT substr(text, 1, 24) FROM benchmark
UNION ALL SELECT * FROM VALUES ('quement'), ('é'), ('ê è'), ('eau '), ('@'), ('  '), ('') v(term)
"""
# Protected values: whole benchmark passages, shorter and longer parts of documents, values that overlap each other and themselves.
VALUE_ROWS = """
SELECT item_id AS pos, 'passage' || CAST(item_id % 30 AS STRING) AS name, text AS value, CASE WHEN item_id % 3 = 0 THEN 'block' ELSE 'mask' END AS action, item_id % 10 <> 9 AS enabled, 'value' AS kind FROM benchmark
UNION ALL SELECT 1000 + doc_id, 'whole' || CAST(doc_id AS STRING), text, 'mask', true, 'value' FROM documents WHERE doc_id % 20 = 0
UNION ALL SELECT 100000 + item_id, 'begin' || CAST(item_id AS STRING), substr(text, 1, 12), 'mask', true, 'value' FROM benchmark
UNION ALL SELECT * FROM VALUES (999990, 'self', 'anan', 'mask', true, 'value'), (999991, 'end', 'nanan', 'block', true, 'value'), (999992, 'folder', '/srv/keys', 'mask', true, 'path') v(pos, name, value, action, enabled, kind)
"""
_CASTS = {"explode(split(text, '[^A-Za-z]+'))": "unnest(string_split_regex(text, '[^A-Za-z]+'))", "SELECT * FROM VALUES": "SELECT * FROM (VALUES", " v(": ") v("}


def _duck(sql: str) -> str:
    for spark_form, duck_form in _CASTS.items():
        sql = sql.replace(spark_form, duck_form)
    return sql


DOCS = "SELECT doc_id AS id, text FROM documents"
D_TERMS = f"""tt AS (SELECT min(trim(term)) AS term FROM ({_duck(TERM_ROWS)}) WHERE trim(term) <> '' GROUP BY lower(trim(term))),
tk AS (SELECT *, regexp_full_match(term, '[A-Za-z0-9]+') AS word FROM tt),
{d_spans('tw', DOCS, '[A-Za-z0-9]+')},
tx AS (SELECT id, term, string_split(text, term) AS g FROM ({DOCS}) d JOIN tk ON NOT word AND contains(text, term)),
th AS (SELECT id, start, len, term, tok FROM tw JOIN tk ON word AND lower(tok) = lower(term)
  UNION ALL SELECT id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * length(term) AS BIGINT), length(term), term, term FROM (SELECT *, unnest(range(1, len(g))) AS i FROM tx))"""
register(
    "dictionary_terms",
    lambda s, sf: plain(dc.find_terms(table(s, sf, "documents"), dc.clean_terms(view(s, sf, TERM_ROWS)), ["doc_id"], "text").drop("original")),
    f"WITH {D_TERMS} SELECT id AS doc_id, start, len, 'CUSTOM_TERM' AS tag, term FROM th",
)

# Places of a value: where its first eight characters stand, and then the whole.
D_VALUES = f"""vr AS (SELECT * FROM ({_duck(VALUE_ROWS)}) WHERE enabled AND kind = 'value'),
vc AS (SELECT id, text, vr.* FROM ({DOCS}) d JOIN vr ON contains(text, value)),
vp AS (SELECT *, unnest(list_filter(range(1, length(text) - length(value) + 2), lambda i: substr(text, CAST(i AS INT), 4) = substr(value, 1, 4) AND substr(text, CAST(i AS INT), length(value)) = value)) AS i FROM vc),
vh AS (SELECT id, text, CAST(i - 1 AS BIGINT) AS start, CAST(length(value) AS BIGINT) AS len, action, name, pos, value FROM vp)"""
register(
    "dictionary_values",
    lambda s, sf: plain(dc.find_values(table(s, sf, "documents"), view(s, sf, VALUE_ROWS), ["doc_id"], "text").withColumn("digest", F.md5("original")).drop("original")),
    f"WITH {D_VALUES} SELECT id AS doc_id, start, len, action, name AS locker_entry, CAST(pos AS BIGINT) AS pos, md5(value) AS digest FROM vh",
)
register(
    "dictionary_names",
    lambda s, sf: dc.entry_names(table(s, sf, "documents"), view(s, sf, VALUE_ROWS), ["doc_id"], "text"),
    f"""WITH vr AS (SELECT * FROM ({_duck(VALUE_ROWS)}) WHERE enabled AND kind = 'value'), f AS (SELECT name, arg_min(value, pos) AS value FROM vr GROUP BY name)
    SELECT id AS doc_id, name AS entry FROM ({DOCS}) d JOIN f ON contains(text, value)""",
)
_UNION = """ UNION ALL SELECT id, NULL, tok, start, len, 10010, 'CUSTOM_TERM', '' FROM th UNION ALL SELECT id, NULL, value, start, len, 20000 + pos, 'LOCKER', 'locker' FROM vh"""
register(
    "dictionary_scan",
    lambda s, sf: plain(
        hits_long(dc.scan_with(table(s, sf, "documents"), ["doc_id"], [_email()], None, dc.clean_terms(view(s, sf, TERM_ROWS)), view(s, sf, VALUE_ROWS), "text"), ["doc_id"]).select("doc_id", "start", "len", "tag", "rule_id")
    ),
    f"WITH RECURSIVE {D_TERMS}, {D_VALUES}, {d_rule('em', DOCS, 'EMAIL')}, "
    + d_resolve("h", "SELECT id, NULL AS text, tok, start, len, 0 AS pri, 'EMAIL' AS tag, 'builtin.email' AS rule_id FROM em" + _UNION)
    + " SELECT id AS doc_id, start, len, tag, rule_id FROM h",
)


def _email():
    from veilspark.operators.detect import builtin_rules

    return next(r for r in builtin_rules() if r.tag == "EMAIL")
