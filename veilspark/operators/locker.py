"""Protected values and paths: cleaning the entry list, exact value search, name lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark import fixed_values as fx
from veilspark.functions.matching import Matcher
from veilspark.functions.spans import empty
from veilspark.operators.semantic import _quote

PRI_BASE = 20_000


@dataclass(frozen=True)
class LockerEntry:
    name: str
    value: str
    action: str = "mask"
    enabled: bool = True
    kind: str = "value"


def _first(chars: int | None) -> Column:
    return F.col("value") if chars is None else F.left("value", F.lit(chars))


def locker_clean(entries: DataFrame, max_value: int | None = None, max_path: int | None = None, max_entries: int | None = None) -> DataFrame:
    """Clean an entry table ``(pos, name, value, action, enabled, kind)``.

    Trim, drop short values and unnamed values, name a path by its last segment, force paths to ``mask``, keep the
    first entry per name.  Values and paths are cut and entries beyond a number dropped only if asked for: the rest of a cut value
    would stay in clear.  Tables of any size are searched by ``operators.dictionary``.
    """
    vmin, pmin = fx.LOCKER_VALUE_MIN_CHARS, fx.LOCKER_PATH_MIN_CHARS
    is_path = F.col("kind") == "path"
    value = F.trim("value")
    tail = F.element_at(F.filter(F.split("value", r"[\\/]"), lambda s: s != ""), -1)
    df = (
        entries.withColumn("kind", F.when(is_path, "path").otherwise("value"))
        .withColumn("value", value)
        .where(F.length("value") >= F.when(is_path, pmin).otherwise(vmin))
        .withColumn("value", F.when(is_path, _first(max_path)).otherwise(_first(max_value)))
        .withColumn("name", F.trim("name"))
        .withColumn("name", F.when((F.col("name") == "") & is_path, F.coalesce(tail, "value")).otherwise(F.col("name")))
        .where("name <> ''")
        .withColumn("name", F.left("name", F.lit(fx.LOCKER_NAME_MAX)))
        .withColumn("action", F.when(~is_path & (F.col("action") == "block"), "block").otherwise("mask"))
    )
    # Values may be long and an aggregate of strings sorts its rows, so the entries to keep are chosen by name and place alone.
    chosen = df.groupBy(F.col("name").alias("__name")).agg(F.min("pos").alias("__pos"))
    first = (
        df.join(chosen, (F.col("name") == F.col("__name")) & F.col("pos").eqNullSafe(F.col("__pos")), "left_semi")
        .groupBy("name")
        .agg(F.min_by(F.struct("pos", "value", "action", "enabled", "kind"), "pos").alias("e"))
        .select(F.col("e.pos"), "name", F.col("e.value"), F.col("e.action"), F.col("e.enabled"), F.col("e.kind"))
    )
    return first if max_entries is None else first.orderBy("pos").limit(max_entries)


def active_values(entries) -> list[LockerEntry]:
    return [e for e in entries if e.enabled and e.kind == "value"]


def locker_matchers(entries) -> list[Matcher]:
    """One matcher per enabled value.  The look-ahead finds overlapping occurrences too."""
    return [
        Matcher(
            "(?s)(?=" + _quote(e.value) + ").", "LOCKER", PRI_BASE + i, rule_id="locker",
            action="block" if e.action == "block" else "mask", needle=e.value, entry=e.name, value=e.value,
        )
        for i, e in enumerate(active_values(entries))
    ]


def locker_entry_names(text: Column, entries) -> Column:
    """Names of the entries whose value occurs in the text, each once, in list order."""
    first: dict[str, LockerEntry] = {}
    for e in active_values(entries):
        first.setdefault(e.name, e)
    if not first:
        return empty("array<string>")
    rows = F.array(*[F.struct(F.lit(e.name).alias("n"), F.lit(e.value).alias("v")) for e in first.values()])
    return F.transform(F.filter(rows, lambda r: F.contains(text, r["v"])), lambda r: r["n"])
