"""Helpers of the registered queries: inputs by SQL, plain output types, oracle SQL fragments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.plans.seeded import _id_sum
from veilspark.sources.messages import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, sql: str, key: str | None = None) -> DataFrame:
    """Run shared SQL over the given tables; times become TIMESTAMP.  ``key`` spreads small inputs."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, sf, name).createOrReplaceTempView(name)
    df = spark.sql(sql)
    if key:
        df = spread(df, key)
    for name, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(name, F.col(name).cast("timestamp"))
    return df


def us(col: str = "ts") -> Column:
    """Microseconds since 1970 in wall-clock terms, whatever the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({col} AS TIMESTAMP_NTZ))")


def plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, times as microseconds, string arrays as comma lists."""
    for name, kind in df.dtypes:
        if kind in ("int", "smallint", "tinyint"):
            df = df.withColumn(name, F.col(name).cast("bigint"))
        elif kind.startswith("timestamp"):
            df = df.withColumn(name, us(name))
        elif kind == "array<string>":
            df = df.withColumn(name, F.array_join(name, ","))
    return df


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- oracle fragments (DuckDB) --------------------------------------------------------------------


def d_spans(name: str, src: str, pattern: str, where: str = "true") -> str:
    """CTEs giving ``(id, text, tok, start, len, prev, next)`` for all matches; start in characters."""
    p = q(pattern)
    return f"""
{name}_p AS (SELECT id, text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM ({src})
  WHERE regexp_matches(text, {p})),
{name}_i AS (SELECT id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_p),
{name}_s AS (SELECT id, text, m[i] AS tok,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start,
  CAST(length(m[i]) AS BIGINT) AS len FROM {name}_i),
{name} AS (SELECT * FROM (SELECT *, CASE WHEN start > 0 THEN substr(text, start, 1) ELSE '' END AS prev,
  substr(text, start + len + 1, 1) AS next FROM {name}_s) WHERE {where})"""


NOT_BETWEEN_DIGITS = "NOT regexp_matches(prev, '[0-9]') AND NOT regexp_matches(next, '[0-9]')"
D_ID_OK = f"length(tok) = 18 AND substr('{fx.ID_CHECK_CHARS}', CAST(({_id_sum('tok')}) % 11 + 1 AS INT), 1) = upper(substr(tok, 18, 1))"
D_LUHN_OK = (
    "list_sum(list_transform(range(0, length(tok)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(tok, CAST(length(tok) - i AS INT), 1) AS BIGINT)"
    " ELSE CAST(substr(tok, CAST(length(tok) - i AS INT), 1) AS BIGINT) * 2 - CASE WHEN CAST(substr(tok, CAST(length(tok) - i AS INT), 1) AS BIGINT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
)
D_IP_OK = (
    "tok NOT IN ('127.0.0.1', '0.0.0.0', '255.255.255.255') AND len(list_filter(string_split(tok, '.'), lambda o: CAST(o AS INT) > 255)) = 0"
)
RULE_WHERE = {
    "IDCARD": f"{D_ID_OK} AND {NOT_BETWEEN_DIGITS}",
    "PHONE": NOT_BETWEEN_DIGITS,
    "BANKCARD": f"{D_LUHN_OK} AND {NOT_BETWEEN_DIGITS}",
    "EMAIL": "true",
    "APIKEY": "true",
    "IP": D_IP_OK,
}
RULES = {tag: (rid, pattern) for rid, tag, pattern, _ in fx.BUILTIN_RULES}
DEFAULT_TAGS = [tag for _, tag, _, on in fx.BUILTIN_RULES if on]


def d_rule(name: str, src: str, tag: str) -> str:
    return d_spans(name, src, RULES[tag][1], RULE_WHERE[tag])


def d_resolve(name: str, hits_sql: str) -> str:
    """Recursive CTEs that keep hits greedily by start, longest, priority (needs WITH RECURSIVE)."""
    return f"""
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start, len DESC, pri) AS rn FROM ({hits_sql})),
{name}_w AS (
  SELECT *, true AS keep, start + len AS covered FROM {name}_o WHERE rn = 1
  UNION ALL
  SELECT o.*, o.start >= w.covered AS keep, CASE WHEN o.start >= w.covered THEN o.start + o.len ELSE w.covered END AS covered
  FROM {name}_w w JOIN {name}_o o ON o.id = w.id AND o.rn = w.rn + 1),
{name} AS (SELECT * EXCLUDE (rn, keep, covered) FROM {name}_w WHERE keep)"""


def d_scan(name: str, src: str, tags=None, extra: str = "") -> str:
    """CTEs: resolved rule hits ``(id, text, tok, start, len, pri, tag, rule_id)``."""
    tags = tags or DEFAULT_TAGS
    order = [t for _, t, _, _ in fx.BUILTIN_RULES]
    parts = [d_rule(f"{name}_{t.lower()}", src, t) for t in tags]
    union = " UNION ALL ".join(
        f"SELECT id, text, tok, start, len, {order.index(t)} AS pri, '{t}' AS tag, '{RULES[t][0]}' AS rule_id FROM {name}_{t.lower()}"
        for t in tags
    )
    return ",".join(parts) + "," + d_resolve(name, union + extra)


def d_splice(name: str, src: str, edits: str) -> str:
    """CTEs: ``(id, out)`` from texts ``(id, text)`` and edits ``(id, start, len, repl)``."""
    return f"""
{name}_e AS (SELECT e.id, s.text, e.start, e.len, e.repl,
  coalesce(lag(e.start + e.len) OVER (PARTITION BY e.id ORDER BY e.start), 0) AS from_at FROM ({edits}) e JOIN ({src}) s ON s.id = e.id),
{name}_a AS (SELECT id, string_agg(substr(text, from_at + 1, start - from_at) || repl, '' ORDER BY start) AS head, max(start + len) AS done FROM {name}_e GROUP BY id),
{name} AS (SELECT s.id, CASE WHEN a.id IS NULL THEN s.text ELSE a.head || substr(s.text, a.done + 1) END AS out
  FROM ({src}) s LEFT JOIN {name}_a a ON a.id = s.id)"""
