"""Span kernel: character offsets of regex matches as native column expressions.

A text is cut once into gaps (``split``) and matches (``regexp_extract_all``); a running sum over
both gives every offset.  The sum runs in blocks, so a row with many matches costs linear time.
Patterns must not match the empty string.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
_BUILT: dict = {}


def once_per_session(build):
    """Build a large column expression once per Spark application and reuse it.

    Columns are immutable descriptions; building one takes many calls into the JVM, which would
    otherwise be the largest fixed cost of a small query.  Arguments must be hashable.
    """

    @functools.wraps(build)
    def call(*args) -> Column:
        key = (build.__module__, build.__qualname__, SparkContext.getOrCreate().applicationId, args)
        if key not in _BUILT:
            _BUILT[key] = build(*args)
        return _BUILT[key]

    return call

SPAN_TYPE = "array<struct<start:int,len:int,text:string,before:string,after:string>>"


def uni(pattern: str) -> str:
    """Unicode meaning for \\d, \\w, \\s, \\b and for case folding."""
    return "(?iU)" + pattern[4:] if pattern.startswith("(?i)") else "(?U)" + pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that later filters on them read the value.

    A filter on a projected column is pushed down with the whole expression copied into it; a generator
    of one row keeps the value where it was computed.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def empty(ddl: str) -> Column:
    return F.array().cast(ddl)


def fold_emit(
    items: Column,
    init: Column,
    step: Callable[[Column, Column], Column],
    out_type: str,
) -> Column:
    """Left fold that emits: ``step(state, item)`` gives ``struct(state, out)`` with ``out`` an array.

    ``items`` should be a column or a ``let`` variable.  Emitted elements are gathered per block of
    ``BLOCK`` items and flattened at the end, so appends stay short.
    """

    def block(state: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(state.alias("state"), empty(out_type).alias("out")),
            lambda acc, x: let(
                step(acc["state"], x),
                lambda r: F.struct(
                    r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")
                ),
            ),
        )

    n_blocks = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    done = F.aggregate(
        F.sequence(F.lit(0), F.greatest(n_blocks, F.lit(0))),
        F.struct(init.alias("state"), empty(f"array<{out_type}>").alias("outs")),
        lambda acc, k: let(
            block(acc["state"], F.slice(items, k * BLOCK + 1, BLOCK)),
            lambda r: F.struct(
                r["state"].alias("state"),
                F.concat(acc["outs"], F.array(r["out"])).alias("outs"),
            ),
        ),
    )
    return F.flatten(done["outs"])


PART_TYPE = "gaps:array<string>,hits:array<string>"


def match_parts(text: Column, pattern: str | Column, *meta: Column) -> Column:
    """The gaps and matches of a pattern as an array of one struct, empty if nothing matches."""
    pat = F.lit(pattern) if isinstance(pattern, str) else pattern
    return let(
        F.regexp_extract_all(text, pat, F.lit(0)),
        lambda hits: F.when(
            F.size(hits) > 0, F.array(F.struct(F.split(text, pat, -1).alias("gaps"), hits.alias("hits"), *meta))
        ),
    )


def walk_parts(parts: Column, behind: int = 0, ahead: int = 0) -> Column:
    """Spans from gaps and matches: a running sum gives every start."""

    def after(i: Column) -> Column:
        pieces = []
        for k in range(1, ahead + 1):
            pieces.append(F.left(F.coalesce(F.get(parts["gaps"], i + k), F.lit("")), F.lit(ahead)))
            pieces.append(F.left(F.coalesce(F.get(parts["hits"], i + k), F.lit("")), F.lit(ahead)))
        return F.left(F.concat(*pieces), F.lit(ahead)) if pieces else F.lit("")

    items = F.transform(
        parts["hits"],
        lambda hit, i: F.struct(F.get(parts["gaps"], i).alias("gap"), hit.alias("hit"), after(i).alias("after")),
    )

    def step(state: Column, x: Column) -> Column:
        start = (state["pos"] + F.length(x["gap"])).cast("int")
        before = F.right(F.concat(state["tail"], x["gap"]), F.lit(behind)) if behind else F.lit("")
        tail = F.right(F.concat(before, x["hit"]), F.lit(behind)) if behind else F.lit("")
        return F.struct(
            F.struct((start + F.length(x["hit"])).cast("int").alias("pos"), tail.alias("tail")).alias("state"),
            F.array(
                F.struct(
                    start.alias("start"),
                    F.length(x["hit"]).alias("len"),
                    x["hit"].alias("text"),
                    before.alias("before"),
                    x["after"].alias("after"),
                )
            ).alias("out"),
        )

    init = F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"))
    return let(items, lambda xs: fold_emit(xs, init, step, SPAN_TYPE))


def spans(text: Column, pattern: str | Column, behind: int = 0, ahead: int = 0) -> Column:
    """All non-overlapping matches as ``(start, len, text, before, after)``, start in characters.

    ``before``/``after`` hold up to ``behind``/``ahead`` neighbouring characters.
    """
    parts = F.coalesce(match_parts(text, pattern), F.array().cast(f"array<struct<{PART_TYPE}>>"))
    return F.flatten(F.transform(parts, lambda p: walk_parts(p, behind, ahead)))


def digit_adjacent(span: Column) -> Column:
    """True when the neighbour on either side is an ASCII digit (needs behind=1, ahead=1)."""
    return F.rlike(span["before"], F.lit("[0-9]$")) | F.rlike(span["after"], F.lit("^[0-9]"))


HIT_FIELDS = (
    "start:int,neg_len:int,pri:int,len:int,tag:string,action:string,rule_id:string,"
    "min_confirm:int,validated:boolean,locker_entry:string,original:string"
)
HITS_TYPE = f"array<struct<{HIT_FIELDS}>>"


def resolve_overlaps(hits: Column) -> Column:
    """Sort by start, longest first, source order; keep a hit only if it starts past the last kept one."""

    def step(state: Column, h: Column) -> Column:
        keep = h["start"] >= state["covered"]
        return F.struct(
            F.struct(
                F.when(keep, h["start"] + h["len"]).otherwise(state["covered"]).cast("int").alias("covered")
            ).alias("state"),
            F.when(keep, F.array(h)).otherwise(empty(HITS_TYPE)).alias("out"),
        )

    return let(
        hits,
        lambda hs: F.when(F.size(hs) <= 1, hs).otherwise(
            let(
                F.array_sort(hs),
                lambda xs: fold_emit(xs, F.struct(F.lit(0).alias("covered")), step, HITS_TYPE),
            )
        ),
    )
