"""Restoring originals: strict and escaped placeholders first, then stripped ones; never a guess."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.spans import once_per_session, spans
from veilspark.functions.text import json_escape_inside
from veilspark.operators.redact import EDIT_TYPE, splice

STAT_NAMES = ("restored", "unresolved", "degraded", "blocked")
PARTS = r"PII:([A-Za-z0-9_]{1,32}):([0-9a-fA-F]{8})"


def suffix_index(vault: DataFrame) -> DataFrame:
    """The vault with ``unique_suffix``: the suffix belongs to one placeholder over all sessions."""
    per = vault.groupBy("suffix").agg((F.min("placeholder") == F.max("placeholder")).alias("unique_suffix"))
    return vault.join(per, "suffix")


@once_per_session
def _token_spans(text: str, pattern: str):
    return spans(F.col(text), pattern, behind=1, ahead=1)


def _tokens(rows: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    tok = rows.select(*keys, "session", F.explode(_token_spans(text, pattern)).alias("s"))
    whole = F.col("s.text")
    bare = F.replace(whole, F.lit("\\"), F.lit(""))
    word = F.rlike(F.col("s.before"), F.lit("[A-Za-z0-9_]$")) | F.rlike(F.col("s.after"), F.lit("^[A-Za-z0-9_]"))
    suffix = F.lower(F.regexp_extract(whole, PARTS, 2))
    return tok.select(
        *keys,
        "session",
        F.col("s.start").alias("start"),
        F.col("s.len").alias("len"),
        whole.alias("whole"),
        suffix.alias("suffix"),
        F.concat(F.lit("[[PII:"), F.upper(F.regexp_extract(whole, PARTS, 1)), F.lit(":"), suffix, F.lit("]]")).alias("canonical"),
        (F.startswith(bare, F.lit("[[")) & F.endswith(bare, F.lit("]]"))).alias("strict_form"),
        word.alias("in_word"),
    )


def resolve_tokens(tokens: DataFrame, vault: DataFrame) -> DataFrame:
    """Add ``original`` and ``fallback``: exact in the session, else by a globally unique suffix.

    ``vault`` needs ``unique_suffix`` (see ``suffix_index``).  Both ways share one join key, and at most
    one vault row can match a token.
    """
    v = vault.select(
        F.col("session").alias("v_session"), F.col("suffix").alias("v_suffix"),
        F.col("placeholder").alias("v_placeholder"), "original", "unique_suffix",
    )
    cond = (
        (F.col("session") == F.col("v_session"))
        & (F.col("suffix") == F.col("v_suffix"))
        & ((F.col("v_placeholder") == F.col("canonical")) | F.col("unique_suffix"))
    )
    return (
        tokens.join(v, cond, "left")
        .withColumn("fallback", F.col("original").isNotNull() & (F.col("v_placeholder") != F.col("canonical")))
        .drop("v_session", "v_suffix", "v_placeholder", "unique_suffix")
    )


Resolver = Callable[[Column, Column], Column]


def _resolved_elsewhere(tokens: DataFrame, resolver: DataFrame | Resolver) -> DataFrame:
    """Fills ``original`` where the vault has none, from a function of session and placeholder or from a table of them."""
    if isinstance(resolver, DataFrame):
        # One row a placeholder: a source that contradicts itself gives the least original.
        more = resolver.groupBy(F.col("session").alias("_session"), F.col("placeholder").alias("_placeholder")).agg(F.min("original").alias("_more"))
        tokens = tokens.join(more, F.col("session").eqNullSafe(F.col("_session")) & (F.col("canonical") == F.col("_placeholder")), "left")
        return tokens.withColumn("original", F.coalesce("original", "_more")).drop("_session", "_placeholder", "_more")
    return tokens.withColumn("original", F.coalesce(F.col("original"), resolver(F.col("session"), F.col("canonical"))))


def _pass(rows: DataFrame, vault: DataFrame, keys: list[str], text: str, loose: bool, escape: str | None, resolver: DataFrame | Resolver | None = None) -> DataFrame:
    """One replacement pass; adds to the counters of ``rows``."""
    extra = [] if escape is None else [escape]
    tokens = _tokens(rows, keys + extra, text, fx.LOOSE_PLACEHOLDER if loose else fx.STRICT_PLACEHOLDER)
    if loose:
        tokens = tokens.where(~F.col("strict_form") & ~F.col("in_word"))
    done = resolve_tokens(tokens, vault)
    if resolver is not None:
        done = _resolved_elsewhere(done, resolver)
    found = F.col("original").isNotNull()
    value = F.col("original") if escape is None else F.when(
        F.col(escape), json_escape_inside(F.col("original"))
    ).otherwise(F.col("original"))
    degraded = found if loose else found & (F.col("fallback") | (F.col("whole") != F.col("canonical")))
    per = done.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.when(found, F.struct("start", "len", value.alias("text"))))
        ).cast(EDIT_TYPE).alias("__edits"),
        F.count_if(found).alias("__restored"),
        F.count_if(~found).alias("__unresolved"),
        F.count_if(degraded).alias("__degraded"),
    )
    out = rows.join(per, keys, "left")
    zero = F.lit(0)
    return (
        out.withColumn(text, F.when(F.col("__edits").isNull(), F.col(text)).otherwise(splice(F.col(text), F.col("__edits"))))
        .withColumn("restored", F.col("restored") + F.coalesce("__restored", zero))
        .withColumn("unresolved", F.col("unresolved") + F.coalesce("__unresolved", zero))
        .withColumn("degraded", F.col("degraded") + F.coalesce("__degraded", zero))
        .drop("__edits", "__restored", "__unresolved", "__degraded")
    )


def restore(
    messages: DataFrame,
    vault: DataFrame,
    keys: list[str],
    text: str = "body",
    out: str = "restored_text",
    loose: bool = True,
    escape: str | None = None,
    resolver: DataFrame | Resolver | None = None,
) -> DataFrame:
    """Restore placeholders of the same session.  ``keys`` must identify a row.

    Adds the text and the counters.  ``escape`` names a boolean column: the value goes inside a JSON
    string and must be escaped.  Rows without ``PII:`` take no part in any shuffle.

    ``resolver`` is asked for what the vault lacks: a table ``(session, placeholder, original)``, or a function of the columns session and
    placeholder (tag in capitals, suffix in small letters) that gives the original or null.
    """
    v = suffix_index(vault)
    zero = F.lit(0).cast("long")
    df = messages.withColumn(out, F.col(text)).withColumns(dict.fromkeys(STAT_NAMES, zero))
    has = F.contains(F.col(text), F.lit("PII:"))
    rows = _pass(df.where(has), v, keys, out, loose=False, escape=escape, resolver=resolver)
    if loose:
        rows = _pass(rows, v, keys, out, loose=True, escape=escape, resolver=resolver)
    return rows.unionByName(df.where(~has))


def restore_stats(restored: DataFrame, by: list[str]) -> DataFrame:
    return restored.groupBy(*by).agg(*[F.sum(s).alias(s) for s in STAT_NAMES])


def join_chunks(chunks: DataFrame, by: list[str], order: str = "seq", text: str = "text") -> DataFrame:
    """The chunks of one reply channel in order, as one text."""
    return chunks.groupBy(*by).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), ""
        ).alias("body")
    )


def restore_chunks(chunks: DataFrame, vault: DataFrame, by: list[str], order: str = "seq") -> DataFrame:
    """Restore a chunked reply: the result equals restoring the concatenation."""
    joined = join_chunks(chunks.select("session", *by, order, "text"), ["session", *by], order)
    return restore(joined, vault, ["session", *by])


def leftover_audit(replies: DataFrame, vault: DataFrame, keys: list[str], text: str = "body") -> DataFrame:
    """Strict placeholders still in the answers, per session: total and unknown to that session.

    A placeholder counts once for each vault row that gives it an original, also by its suffix alone; a vault of :func:`vault_mint` has one at most.
    """
    tok = _tokens(replies.where(F.contains(F.col(text), F.lit("PII:"))), keys, text, fx.STRICT_PLACEHOLDER)
    exact = F.col("original").isNotNull() & ~F.col("fallback")
    return resolve_tokens(tok, suffix_index(vault)).groupBy("session").agg(F.count(F.lit(1)).alias("leftover"), F.count_if(~exact).alias("unknown"))
