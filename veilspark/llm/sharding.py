"""Proportional stratified interleaving into shards of equal row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import cut, text_bytes


def _ranked(df: DataFrame, group: list[str], bucket: Column, order: list, buckets: int, to: str) -> DataFrame:
    """Adds the rank from 0 within ``group`` as ``to`` and the group's size as ``<to>_of``.

    Rows are cut into ``buckets`` ordered ranges; the ranges' counts give each range its first rank, and only
    the rows of one range are sorted together.  So no task sees a whole group.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``buckets`` rows a group: the counts of ranges, never the rows themselves.
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    offsets = counts.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_bucket").alias("_at"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"), F.sum("_n").over(whole).alias(f"{to}_of"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    df = df.withColumn("_row", F.row_number().over(inside))
    same = F.col("_bucket") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return df.join(offsets, same).withColumn(to, F.col("_from") + F.col("_row") - 1).drop("_bucket", "_at", "_from", "_row", *(f"_g_{g}" for g in group))


def interleave(docs: DataFrame, shards: int = 40, seed: int = 17, rows_per_range: int = 20_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs``.

    Rows are shuffled by a seeded hash within their source; a row's fractional rank is (rank + 1/2) / rows of the
    source.  In the order of fractional ranks all sources run evenly through the whole, and the order is cut into
    ``shards`` pieces whose row counts differ by one at most (law ``rows``), so each shard has the mixture of the
    whole up to rounding.  Size is the text's UTF-8 bytes plus 16.

    A null text has size 16 and the checksum of no bytes; a null source is a source; a null id is placed like any
    other.  Repeated rows are placed one by one.  Other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (text_bytes(text_col) + 16).alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_crc32").cast("string"), F.col("size").cast("string")).cast("binary"))
    rows = cut(rows.withColumn("h", key))
    total = rows.count()
    buckets = max(1, -(-total // rows_per_range))
    lead = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint")
    first = _ranked(rows, ["source"], F.shiftright(lead * buckets, 32), ["h", "doc_id"], buckets, "rank")
    first = cut(first.withColumn("part", (F.col("rank") + 0.5) / F.col("rank_of")).drop("rank", "rank_of"))
    second = _ranked(first, [], F.floor(F.col("part") * buckets), ["part", "source", "h", "doc_id"], buckets, "place")
    shard = F.expr(f"cast((place * {shards}) div {max(total, 1)} as int)")
    return second.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"place - (shard * cast({total} as bigint) + {shards - 1}) div {shards}").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
