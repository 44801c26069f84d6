"""Text places of reply events: one pass over the parsed event in the tasks, on Arrow batches."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.json_walk import _walk

SLOT = "struct<path:string,channel:string,text:string,escape:boolean>"
#: A path that leads through a field of the protocol, not of the content.
PROTOCOL_PATH = re.compile(r"\.(?:" + "|".join(fx.PROTOCOL_KEYS) + r")(?:[.\[]|\Z)")
TEXT_KEYS = (("content", "content"), ("reasoning_content", "reason"), ("reasoning", "reason"))
WHOLE = re.compile(r"[+-]?[0-9]+", re.A)


def is_object(data: Column) -> Column:
    """True for a JSON object, false for all else and null."""
    return F.coalesce(F.rlike(data, F.lit(r"\A[ \t\r\n]*\{")) & F.try_parse_json(data).isNotNull(), F.lit(False))


def _get(value, *path: str):
    for key in path:
        if not isinstance(value, dict):
            return None
        value = value.get(key)
    return value


def _number(value) -> int | None:
    """What the value is as a BIGINT: fractions are cut, and a string may hold a whole number."""
    if isinstance(value, str):
        value = value.strip(" \t\r\n")
        if not WHOLE.fullmatch(value) or len(value) > 1000:
            return None
    elif isinstance(value, Decimal):
        if value.adjusted() > 19:
            return None
    elif not isinstance(value, int):
        return None
    number = int(value)
    return number if -(1 << 63) <= number < 1 << 63 else None


def _list(value) -> list:
    return value if isinstance(value, list) else []


def _known(data: dict) -> list[tuple]:
    """Known text places of one event: path, channel, text, and whether it is JSON inside."""
    out: list[tuple] = []

    def add(path: str, channel: str, text, escape: bool = False) -> None:
        if isinstance(text, str) and text:
            out.append((path, channel, text, escape))

    for i, c in enumerate(_list(data.get("choices"))):
        if not isinstance(c, dict):
            continue
        if "text" in c:
            add(f"choices[{i}].text", f"text:{i}", c["text"])
        for holder in ("delta", "message"):
            said = c.get(holder)
            if not isinstance(said, dict):
                continue
            for key, channel in TEXT_KEYS:
                text = said.get(key)
                if isinstance(text, str) and text:
                    out.append((f"choices[{i}].{holder}.{key}", f"{channel}:{i}", text, False))
            for j, t in enumerate(_list(said["tool_calls"]) if "tool_calls" in said else ()):
                at = _number(_get(t, "index"))
                add(f"choices[{i}].{holder}.tool_calls[{j}].function.arguments", f"args:{j if at is None else at}", _get(t, "function", "arguments"), True)
    kind = data.get("type")
    if kind in ("content_block_delta", "content_block_start"):
        idx = _number(data.get("index")) or 0
        if kind == "content_block_delta":
            add("delta.text", f"content:{idx}", _get(data, "delta", "text"))
            add("delta.partial_json", f"args:{idx}", _get(data, "delta", "partial_json"), True)
            add("delta.thinking", f"think:{idx}", _get(data, "delta", "thinking"))
        else:
            add("content_block.text", f"content:{idx}", _get(data, "content_block", "text"))
    if "delta" in data:
        in_args = isinstance(kind, str) and "function_call_arguments" in kind
        add("delta", "args:0" if in_args else "content:0", data["delta"], in_args)
    if "type" in data:
        add("text", "content:0", data.get("text"))
    for i, c in enumerate(_list(data["candidates"]) if "candidates" in data else ()):
        for j, p in enumerate(_list(_get(c, "content", "parts"))):
            add(f"candidates[{i}].content.parts[{j}].text", f"gtext:{i}:{j}", _get(p, "text"))
    return out


def _content(body: str) -> list[tuple]:
    """Text values of an event without known text places; what protocol fields hold, at any depth, is left out."""
    nodes: list[tuple] = []
    _walk(body, nodes.append)
    return [(path, "tree:" + (key or "raw"), leaf, key in fx.JSON_TEXT_KEYS) for _, _, path, key, leaf in nodes if path is not None and not PROTOCOL_PATH.search(path)]


def _column(bodies: pa.Array, content: bool) -> pa.Array:
    rows: list[tuple] = []
    ends = [0]
    reader = json.JSONDecoder(parse_float=Decimal)
    for body in bodies.to_pylist():
        if body is not None:
            found = _known(reader.raw_decode(body.lstrip(" \t\r\n"))[0])
            rows.extend(found or (_content(body) if content else []))
        ends.append(len(rows))
    path, channel, text, escape = zip(*rows) if rows else [()] * 4
    # A half of a surrogate pair is no character.
    texts = [t if t is None else t.encode("utf-8", "replace").decode() for t in text]
    columns = [pa.array(path, pa.string()), pa.array(channel, pa.string()), pa.array(texts, pa.string()), pa.array(escape, pa.bool_())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["path", "channel", "text", "escape"]))


def _slots_of(bodies: pa.Array) -> pa.Array:
    return _column(bodies, False)


def _pushes_of(bodies: pa.Array) -> pa.Array:
    return _column(bodies, True)


def text_slots(data: Column) -> Column:
    """Known text places of an event; none for what is no JSON object.  Not for use inside a lambda."""
    return F.arrow_udf(_slots_of, f"array<{SLOT}>")(F.when(is_object(data), data))


def push_slots(data: Column, known_object: Column | None = None) -> Column:
    """Known text places of an event, or all content values of an event that has none of them.  Not for use inside a lambda.

    ``known_object`` is :func:`is_object` of ``data`` where a caller has it.
    """
    return F.arrow_udf(_pushes_of, f"array<{SLOT}>")(F.when(is_object(data) if known_object is None else known_object, data))
