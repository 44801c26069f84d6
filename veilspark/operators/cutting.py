"""Cutting replies into texts and frames block by block, so that one long reply spreads over many tasks.

Chunks are put into blocks by their number.  What a block needs to know of those before it is little: the last three
bytes for characters, the line ends that it begins with for frames.  That is told from block to block over narrow rows; texts stay
in their blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.functions.holdback import Utf8
from veilspark.functions.spans import compute_once
from veilspark.functions.walk import ordered_walk, tasks
from veilspark.sources.lineage import cut, fits

BLOCK = 256
#: Replies of at most so many characters are cut as a whole.
WHOLE = 1 << 23
#: Each match begins where the one before ended, so what has no end is read once and not once per character.
FRAME = r"(?s)\G.*?(?:\r\n\r\n|\n\n)"


def _joined(order: list[str], text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda s: s[text]), "")


def decode(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conn, seq, chunk BINARY)`` to ``(conn, seq, text)``; the rest of a reply gets the next seq.

    Characters cut between chunks go to the later one; invalid bytes are dropped.
    """
    rows = chunks.select("conn", "seq", F.coalesce("chunk", F.lit(b"")).alias("chunk")).withColumn("block", F.floor(F.col("seq") / block).cast("bigint"))
    last3 = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", F.substring("chunk", -3, 3).alias("b")))), F.lit(b""),
                        lambda a, x: F.substring(F.concat(a, x["b"]), -3, 3))
    blocks = rows.groupBy("conn", "block").agg(last3.alias("end"))
    w = W.partitionBy("conn").orderBy("block")
    told = F.substring(F.concat(*[F.coalesce(F.lag("end", k).over(w), F.lit(b"")) for k in (3, 2, 1)]), -3, 3)
    blocks = blocks.withColumn("before", told).withColumn("ends", F.lead("block").over(w).isNull()).select(F.col("conn").alias("_conn"), F.col("block").alias("_block"), "before", "ends")
    placed = rows.join(blocks, F.col("conn").eqNullSafe(F.col("_conn")) & (F.col("block") == F.col("_block"))).drop("_conn", "_block")

    def step(st, row):
        if "utf8" not in st:
            st["utf8"] = Utf8()
            st["utf8"].push(bytes(row["before"]))
        st["seq"], st["ends"] = row["seq"], row["ends"]
        return [(row["conn"], row["seq"], st["utf8"].push(bytes(row["chunk"])))]

    def finish(st, key):
        rest = st["utf8"].finish() if st["ends"] else ""
        return [(key[0], st["seq"] + 1, rest)] if rest else []

    return ordered_walk(placed, ["conn", "block"], ["seq"], dict, step, finish, "conn string, seq long, text string")


def _frames_of(texts: DataFrame) -> DataFrame:
    """Adds ``frames`` of ``text`` and the ``rest`` that no blank line ends."""
    found = compute_once(texts, frames=F.regexp_extract_all("text", F.lit(FRAME), F.lit(0)))
    size = F.aggregate("frames", F.lit(0), lambda a, x: a + F.length(x))
    return found.withColumn("rest", F.substring("text", size + 1, F.length("text"))).drop("text")


def cut_frames(chunks: DataFrame, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """``(conn, seq, text)`` to ``(conn, frame_no, raw)``: frames end with a blank line; what follows the last one is a frame too.

    A frame may be of any length and span any number of chunks.  A reply of more than ``whole`` characters is cut in blocks of its
    chunks, see :func:`_in_blocks`; all others by one task each, in one shuffle.
    """
    rows = chunks.select("conn", "seq", F.coalesce("text", F.lit("")).alias("text"))
    # At most one conn for each ``whole`` characters of the input.
    long = cut(rows.groupBy("conn").agg(F.sum(F.length("text")).alias("size")).where(F.col("size") > whole).select(F.col("conn").alias("_conn")))
    same = F.col("conn").eqNullSafe(F.col("_conn"))
    few = rows
    if not fits(long, 0):
        few = rows.join(F.broadcast(long), same, "left_anti")
    joined = few.repartition(tasks(rows.sparkSession), "conn").groupBy("conn").agg(_joined(["seq"], "text").alias("text"))
    pieces = _frames_of(joined).select("conn", F.posexplode(F.concat("frames", F.array("rest"))).alias("i", "raw")).where("raw <> ''")
    out = pieces.select("conn", F.col("i").cast("bigint").alias("frame_no"), "raw")
    return out if few is rows else out.unionByName(_in_blocks(rows.join(F.broadcast(long), same, "left_semi"), block))


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Frames of replies that spread over many tasks.

    Line ends at the end of a block move to the head of the next one with other characters, so no blank line lies across blocks and
    each block finds its own.
    """
    rows = rows.withColumn("block", F.floor(F.col("seq") / block).cast("bigint"))
    blocks = cut(rows.groupBy("conn", "block").agg(_joined(["seq"], "text").alias("text")))
    w = W.partitionBy("conn").orderBy("block")
    ends = blocks.select("conn", "block", F.regexp_extract("text", r"[\r\n]*\z", 0).alias("ends"), (~F.rlike("text", F.lit(r"[^\r\n]"))).alias("pure"))
    ends = ends.withColumn("grp", F.sum(F.when(F.col("pure"), 0).otherwise(1)).over(w))
    # A group is a block with other characters and the blocks of bare line ends after it.
    groups = ends.groupBy("conn", "grp").agg(_joined(["block"], "ends").alias("ends"), F.min(F.when(~F.col("pure"), F.col("block"))).alias("head"))
    g = W.partitionBy("conn").orderBy("grp")
    groups = groups.withColumn("lead", F.coalesce(F.lag("ends").over(g), F.lit(""))).withColumn("tail", F.when(F.lead("grp").over(g).isNull(), F.col("ends")).otherwise(F.lit("")))
    heads = groups.select(F.col("conn").alias("_conn"), "grp", "head", "lead", "tail")
    own = F.coalesce(F.regexp_replace("text", r"[\r\n]*\z", ""), F.lit(""))
    texts = heads.join(blocks, F.col("_conn").eqNullSafe(F.col("conn")) & (F.col("head") == F.col("block")), "left").select(
        F.col("_conn").alias("conn"), "grp", F.when(F.col("head").isNull() & (F.col("tail") != ""), F.col("tail")).when(F.col("head").isNull(), F.lit("")).otherwise(F.concat("lead", own, "tail")).alias("text"))
    found = cut(_frames_of(texts))
    before = W.partitionBy("_conn").orderBy("_grp").rowsBetween(W.unboundedPreceding, -1)
    starts = found.select(F.col("conn").alias("_conn"), F.col("grp").alias("_grp"), F.size("frames").cast("bigint").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = found.join(starts, F.col("conn").eqNullSafe(F.col("_conn")) & (F.col("grp") == F.col("_grp")))
    pieces = numbered.select("conn", "grp", "first", "n", F.posexplode(F.concat("frames", F.array("rest"))).alias("i", "piece")).withColumn("frame_no", (F.col("first") + F.col("i")).cast("bigint"))
    inner = pieces.where("i > 0 AND i < n").select("conn", "frame_no", F.col("piece").alias("raw"))
    edges = pieces.where("i = 0 OR i = n").groupBy("conn", "frame_no").agg(_joined(["grp"], "piece").alias("raw")).where("raw <> ''")
    return inner.unionByName(edges)
