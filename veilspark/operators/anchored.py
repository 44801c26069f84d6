"""Anchored timers: the first event of a key counts, later ones once a period has passed since the last that counted.

Time is cut into slots as long as the period, so a slot holds one counted event of a key at most, and what follows an event lies in one of the
next two slots, or is a new beginning.  All look-ups are joins on key and slot: neither a busy key nor the lack of any key makes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.sources.lineage import cut


def _meet(left: DataFrame, right: DataFrame, keys: list[str], at: str, how: str = "left") -> DataFrame:
    """Joins on ``at`` and on keys that may be null."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(at).alias("_at"), *[c for c in right.columns if c not in (*keys, at)])
    same = F.col(at) == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named, same, how).drop("_at", *[f"_{k}" for k in keys])


def slot_of(us: Column, period: int) -> Column:
    return ((us - F.pmod(us, F.lit(period))) / F.lit(period)).cast("bigint")


def counted(events: DataFrame, keys: list[str], period: int) -> DataFrame:
    """``keys, us``: the events that count, of ``events`` with ``keys`` and ``us`` (microseconds, from 1970 on); equal rows are one.

    An event with no other in the period before it counts whatever happened earlier.  From there every event points to the first one that
    is a period later; pointers are doubled until nothing new is reached, so a chain of n takes about log2(n) rounds.
    """
    rows = cut(events.select(*keys, "us").distinct().withColumn("slot", slot_of(F.col("us"), period)))
    ends = rows.groupBy(*keys, "slot").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    before = ends.select(*keys, (F.col("slot") + 1).alias("slot"), F.col("high").alias("last"))
    inside = W.partitionBy(*keys, "slot").orderBy("us")
    starts = _meet(rows, before, keys, "slot").withColumn("last", F.coalesce(F.lag("us").over(inside), "last"))
    starts = starts.where(f"last IS NULL OR us - last >= {period}").select(*keys, "us")
    # Each event asks the next slot for the first event from a period later on, else takes the first of the slot after.
    asked = rows.select(*keys, (F.col("us") + period).alias("at"), F.lit(0).alias("side"), (F.col("slot") + 1).alias("slot"), "us").unionByName(
        rows.select(*keys, F.col("us").alias("at"), F.lit(1).alias("side"), "slot", F.lit(None).cast("bigint").alias("us")))
    onward = W.partitionBy(*keys, "slot").orderBy(F.desc("at"), F.desc("side")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = asked.withColumn("near", F.last(F.when(F.col("side") == 1, F.col("at")), ignorenulls=True).over(onward)).where("side = 0")
    after = ends.select(*keys, (F.col("slot") - 1).alias("slot"), "low")
    found = _meet(found, after, keys, "slot").select(*keys, "us", F.coalesce("near", "low").alias("to")).where("to IS NOT NULL")
    jump, reached = cut(found), cut(starts)
    size = reached.count()
    while True:
        step = _meet(reached, jump, keys, "us", "inner").select(*keys, F.col("to").alias("us"))
        reached = cut(reached.unionByName(step).distinct())
        before_size, size = size, reached.count()
        if size == before_size:
            return reached
        far = jump.select(*keys, F.col("us").alias("to"), F.col("to").alias("beyond"))
        jump = cut(_meet(jump, far, keys, "to", "inner").select(*keys, "us", F.col("beyond").alias("to")))


def notices(events: DataFrame, keys: list[str], period: int) -> DataFrame:
    """``keys, count, first_us, notice_us`` of ``events`` with ``keys``, ``us`` and ``n`` (uses at that time).

    A notice counts the uses since the notice before it: one of its own time, and the others of that time with the next
    notice.  ``first_us`` is the time of the notice before, or its own.
    """
    rows = cut(events.groupBy(*keys, "us").agg(F.sum("n").alias("n")).withColumn("slot", slot_of(F.col("us"), period)))
    hit = counted(rows, keys, period)
    by_slot = cut(hit.withColumn("slot", slot_of(F.col("us"), period)))
    # The notice that a use follows stands in its own slot or in the one before.
    own = by_slot.select(*keys, "slot", F.col("us").alias("here"))
    prior = by_slot.select(*keys, (F.col("slot") + 1).alias("slot"), F.col("us").alias("there"))
    placed = _meet(_meet(rows, own, keys, "slot"), prior, keys, "slot").withColumn("of", F.when(F.col("here") <= F.col("us"), F.col("here")).otherwise(F.col("there")))
    per = placed.groupBy(*keys, F.col("of").alias("us")).agg((F.sum("n") - 1).alias("more"))
    order = W.partitionBy(*keys).orderBy("us")
    # At most one row a period and key.
    done = _meet(hit, per, keys, "us").withColumn("first_us", F.lag("us").over(order)).withColumn("count", F.coalesce(F.lag("more").over(order), F.lit(0)) + 1)
    return done.select(*keys, F.col("count").cast("bigint").alias("count"), F.coalesce("first_us", "us").alias("first_us"), F.col("us").alias("notice_us"))
