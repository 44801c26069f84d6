"""JSON bodies: string leaves, redaction in place, tool results.

A JSON text is cut at its string tokens.  Escaped backslashes and quotes are first masked with control
characters, which valid JSON text cannot contain, so a plain ``"[^"]*"`` finds every token, and a token
followed by a colon is a key.  Nothing else of the document is touched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import HIT_FIELDS, compute_once, let, spans
from veilspark.operators.redact import replace_hits, splice

BACKSLASH, QUOTE = "\x01\x01", "\x01\x02"
TOKEN = r'"[^"]*"(?:\s*:)?'
LEAF_TYPE = f"array<struct<start:int,len:int,leaf:string,hits:array<struct<{HIT_FIELDS}>>>>"


def _mask(body: Column) -> Column:
    return F.replace(F.replace(body, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))


def _unmask(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit(BACKSLASH), F.lit("\\\\")), F.lit(QUOTE), F.lit('\\"'))


def json_unquote(token: Column) -> Column:
    """The value of one JSON string token."""
    return F.from_json(F.concat(F.lit('{"v":'), token, F.lit("}")), "v string")["v"]


def json_quote(value: Column) -> Column:
    """The value as a JSON string token."""
    js = F.to_json(F.struct(value.alias("v")))
    return F.substring(js, F.lit(6), F.length(js) - 6)


def _value_tokens(body: Column) -> Column:
    return let(_mask(body), lambda masked: F.filter(spans(masked, TOKEN), lambda s: F.endswith(s["text"], F.lit('"'))))


def is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def json_leaves(body: Column) -> Column:
    """All string values (not keys) of a valid JSON body, in document order."""
    return F.transform(_value_tokens(body), lambda s: json_unquote(_unmask(s["text"])))


def scan_leaves(body: Column, scanner: Callable[[Column], Column]) -> Column:
    """String leaves that have hits, with their place in the body."""
    return F.filter(
        F.transform(
            _value_tokens(body),
            lambda s: let(
                json_unquote(_unmask(s["text"])),
                lambda leaf: F.struct(
                    s["start"].alias("start"), s["len"].alias("len"), leaf.alias("leaf"), scanner(leaf).alias("hits")
                ),
            ),
        ),
        lambda x: F.size(x["hits"]) > 0,
    )


def redact_leaves(body: Column, leaves: Column, replacement: Callable[[Column], Column]) -> Column:
    """Rewrite the scanned leaves in place; structure, keys, numbers and spacing stay as they are."""
    edits = F.transform(
        leaves,
        lambda x: F.struct(
            x["start"].alias("start"),
            x["len"].alias("len"),
            json_quote(replace_hits(x["leaf"], x["hits"], replacement)).alias("text"),
        ),
    )
    return splice(body, edits)


def leaf_hits(leaves: Column) -> Column:
    return F.flatten(F.transform(leaves, lambda x: x["hits"]))


def redact_json(
    messages: DataFrame,
    scanner: Callable[[Column], Column],
    replacement: Callable[[Column], Column],
    body: str = "body",
    only: Column | None = None,
) -> DataFrame:
    """Add ``hits`` (over all leaves) and ``redacted``; a body that is not JSON passes unchanged.

    A body nested too deep for the parser is walked all the same.  Where ``only`` is false the body isn't read.
    """
    from veilspark.functions.json_walk import json_form

    asked = F.lit(True) if only is None else only
    found = F.when(asked & json_form(F.col(body)).isin("json", "deep"), scan_leaves(F.col(body), scanner)).otherwise(F.array().cast(LEAF_TYPE))
    return (
        compute_once(messages, __leaves=found)
        .withColumn("hits", leaf_hits(F.col("__leaves")))
        .withColumn("redacted", redact_leaves(F.col(body), F.col("__leaves"), replacement))
        .drop("__leaves")
    )


def json_string_leaves(messages: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """One row per string leaf with its path; bodies that are no JSON have none and are named by :func:`json_problems`."""
    from veilspark.functions.json_walk import json_nodes

    return compute_once(messages.select(*keys, body), __nodes=json_nodes(F.col(body))).select(*keys, F.inline("__nodes")).select(*keys, "path", F.col("leaf").alias("value"))


def json_problems(messages: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """``keys, form`` of bodies that aren't plain JSON: ``text``, ``deep`` or ``none`` (see ``json_walk.json_form``)."""
    from veilspark.functions.json_walk import json_form

    return compute_once(messages.select(*keys, body), form=json_form(F.col(body))).select(*keys, "form").where("form <> 'json'")


def vtype(v: Column) -> Column:
    """STRING, ARRAY, OBJECT, … of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def vget(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def vstr(v: Column, path: str) -> Column:
    """A string member, NULL if it is missing or not a string."""
    return F.when(vtype(vget(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def varray(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


#: So many results inside results are followed; each level is a part of the plan.
NESTED_RESULTS = 12


def _tool_texts(content: Column, depth: int = NESTED_RESULTS) -> Column:
    """Texts of one tool content: a string, segments, nested results, or any object as JSON."""
    none = F.array().cast("array<string>")

    def item(it: Column) -> Column:
        nested = _tool_texts(vget(it, "$.content"), depth - 1) if depth else none
        return (
            F.when(vstr(it, "$.text").isNotNull(), F.array(vstr(it, "$.text")))
            .when(vstr(it, "$.type") == "tool_result", nested)
            .otherwise(none)
        )

    kind = vtype(content)
    return (
        F.when(kind == "STRING", F.array(F.try_variant_get(content, "$", "string")))
        .when(kind == "ARRAY", F.flatten(F.transform(varray(content, "$"), item)))
        .when(kind == "OBJECT", F.array(F.to_json(content)))
        .otherwise(none)
    )


def tool_result_texts(messages: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Rows ``(keys, ord, slot, text)``: tool outputs in a request body, in document order."""
    def having(*words: str) -> DataFrame:
        """Parsed bodies that may have one of the words; letters hide only behind a backslash."""
        may = reduce(lambda a, b: a | b, [F.contains(F.col(body), F.lit(w)) for w in (*words, "\\")])
        return messages.where(may).select(*keys, F.try_parse_json(F.col(body)).alias("v")).where("v IS NOT NULL")

    label = "concat({}, '#', cast(i AS string))"

    def chat(*words: str) -> DataFrame:
        return having(*words).select(*keys, F.posexplode(varray(F.col("v"), "$.messages")).alias("i", "m"))

    role = vstr(F.col("m"), "$.role")
    plain = chat("tool", "function").where(role.isin("tool", "function")).select(
        *keys, "i", F.lit(0).alias("j"), F.expr(label.format("'tool'")).alias("slot"),
        F.posexplode(_tool_texts(vget(F.col("m"), "$.content"))).alias("k", "text"),
    )
    blocks = (
        chat("tool_result").where(role == "user")
        .select(*keys, "i", F.posexplode(varray(F.col("m"), "$.content")).alias("j", "b"))
        .where(vstr(F.col("b"), "$.type") == "tool_result")
        .select(
            *keys, "i", "j", F.expr(label.format("'tool_result'")).alias("slot"),
            F.posexplode(_tool_texts(vget(F.col("b"), "$.content"))).alias("k", "text"),
        )
    )
    turns = having("functionResponse").select(*keys, F.posexplode(varray(F.col("v"), "$.contents")).alias("i", "m"))
    parts = (
        turns.where(role.isin("function", "tool", "user"))
        .select(*keys, "i", F.posexplode(varray(F.col("m"), "$.parts")).alias("j", "p"))
        .withColumn("r", vget(F.col("p"), "$.functionResponse"))
        .where("r IS NOT NULL")
        .select(
            *keys,
            (F.col("i") + 1_000_000).alias("i"),
            "j",
            F.concat(
                F.lit("functionResponse["), F.coalesce(vstr(F.col("r"), "$.name"), F.lit("")), F.lit("]#"),
                F.col("i").cast("string"),
            ).alias("slot"),
            F.lit(0).alias("k"),
            F.to_json(vget(F.col("r"), "$.response")).alias("text"),
        )
    )
    rows = plain.unionByName(blocks).unionByName(parts).where("text <> ''")
    return rows.select(*keys, F.struct("i", "j", "k").alias("ord"), "slot", "text")
