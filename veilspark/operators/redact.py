"""Redaction: put replacements in place of spans, in plain text and in JSON documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.spans import let

EDIT_TYPE = "array<struct<start:int,len:int,text:string>>"


def splice(text: Column, edits: Column) -> Column:
    """Apply sorted edits ``(start, len, text)`` to a text.

    Edits don't overlap, but several may claim one place: their texts follow each other there, with what stood there between them.
    """

    def build(es: Column) -> Column:
        def end(e: Column) -> Column:
            return e["start"] + e["len"]

        pieces = F.transform(
            es,
            lambda e, i: let(
                F.coalesce(end(F.get(es, i - 1)), F.lit(0)),
                lambda at: F.concat(
                    F.when(e["start"] >= at, F.substring(text, at + 1, e["start"] - at)).otherwise(F.substring(text, e["start"] + 1, at - e["start"])),
                    e["text"],
                ),
            ),
        )
        tail = F.substring(text, end(F.element_at(es, -1)) + 1, F.length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    return let(edits, lambda es: F.when(F.size(es) > 0, build(es)).otherwise(text))


def replace_hits(text: Column, hits: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with every resolved hit replaced; a ``warn`` hit is reported but its text is kept."""
    active = F.filter(hits, lambda h: h["action"] != "warn")
    return splice(
        text,
        F.transform(
            active,
            lambda h: F.struct(h["start"].alias("start"), h["len"].alias("len"), replacement(h).alias("text")),
        ),
    )


def redact(
    scanned: DataFrame,
    replacement: Callable[[Column], Column],
    text: str = "body",
    hits: str = "hits",
    out: str = "redacted",
) -> DataFrame:
    return scanned.withColumn(out, replace_hits(F.col(text), F.col(hits), replacement))
