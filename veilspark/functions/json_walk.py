"""A walk over the tokens of a JSON text as one column expression: every string value with its path and place.

Brackets, commas and string tokens pass one loop with a stack of open containers in the tasks, on Arrow batches, so depth costs a stack
entry and not a level of the plan.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.json_text import TOKEN, _mask, is_json
from veilspark.functions.spans import let

NODE = "array<struct<start:int,len:int,path:string,key:string,leaf:string>>"
#: A string token, with its colon if it is a key; brackets and commas; a backslash outside strings hides what follows it.
EVENT = re.compile(r'\\[\\"]|"(?:[^"\\]|\\.)*"(?:\s*:)?|[\[\]{},]', re.A | re.S)
ESCAPED = re.compile(r"[\\\x00-\x1f]")


def _unquote(token: str) -> str | None:
    """The value of a string token, null for one that JSON doesn't allow."""
    if not ESCAPED.search(token):
        return token[1:-1]
    try:
        # A half of a surrogate pair is no character.
        return json.loads(token).encode("utf-8", "replace").decode()
    except ValueError:
        return None


def _walk(body: str, emit) -> None:
    """Calls ``emit(start, len, path, key, value)`` for each string value; a null path has an unreadable key in it."""
    stack: list[list] = []
    at: str | None = "$"
    key: str | None = ""
    for found in EVENT.finditer(body):
        token = found[0]
        sign, top = token[0], stack[-1] if stack else [None, -1, None]
        if sign in "{[":
            stack.append([at, 0 if sign == "[" else -1, key])
            if sign == "[" and at is not None:
                at += "[0]"
        elif sign in "}]":
            at, _, key = top
            del stack[-1:]
        elif sign == ",":
            if top[1] >= 0:
                top[1] += 1
                at = None if top[0] is None else f"{top[0]}[{top[1]}]"
        elif sign == '"' and token[-1] == ":":
            key = _unquote(token[:-1].rstrip(" \t\n\x0b\f\r"))
            at = None if top[0] is None or key is None else f"{top[0]}.{key}"
        elif sign == '"':
            emit((found.start(), len(token), at, key, _unquote(token)))


def _nodes_of(bodies: pa.Array) -> pa.Array:
    rows: list[tuple] = []
    ends = [0]
    for body in bodies.to_pylist():
        if body is not None:
            _walk(body, rows.append)
        ends.append(len(rows))
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
    values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["start", "len", "path", "key", "leaf"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def json_nodes(body: Column) -> Column:
    """All string values in document order: place of the token, path, nearest key and value.

    Keys stand in a path as they are, after a dot; elements as ``[i]``.  For a text that is no JSON (see :func:`json_form`) the array is empty.
    A null isn't walked: callers hold back what they don't ask for.  Not for use inside a lambda.
    """
    return F.arrow_udf(_nodes_of, NODE)(F.when(json_form(body).isin("json", "deep"), body))


def _depth(body: Column) -> Column:
    """Deepest nesting if all brackets outside strings pair up, else -1."""
    marks = F.regexp_extract_all(F.regexp_replace(_mask(body), TOKEN, ""), F.lit(r"[\[\]{}]"), F.lit(0))
    init = F.struct(F.lit("").alias("open"), F.lit(0).alias("most"), F.lit(True).alias("ok"))
    end = F.aggregate(marks, init, lambda s, c: F.struct(
        F.when(c.isin("{", "["), F.concat(s["open"], c)).otherwise(F.left(s["open"], F.greatest(F.length(s["open"]) - 1, F.lit(0)))).alias("open"),
        F.greatest(s["most"], F.length(s["open"]) + c.isin("{", "[").cast("int")).alias("most"),
        (s["ok"] & (c.isin("{", "[") | (F.right(s["open"], F.lit(1)) == F.when(c == "}", "{").otherwise("[")))).alias("ok")))
    return let(end, lambda s: F.when(s["ok"] & (s["open"] == ""), s["most"]).otherwise(F.lit(-1)))


def json_form(body: Column) -> Column:
    """``json``; ``deep`` for nested brackets that pair up but that the parser refuses; ``text``; ``none`` for null."""
    bracket = F.rlike(body, F.lit(r"^\s*[\[{]")) & F.rlike(body, F.lit(r"[\]}]\s*$"))
    return F.when(body.isNull(), "none").when(is_json(body), "json").when(bracket, F.when(_depth(body) > 500, "deep").otherwise("text")).otherwise("text")
