"""Ranks within groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footscape.session import stored

#: A table of at most so many rows (about 60 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """`rows` with `rank`, from 0, within its group by `order`, nulls first, and `n`, the group's size.

    Rows are dealt out by ranges of group and order, so a group of any size is spread over tasks; equal rows are told
    apart by where they were read. A rank is the place in the range, plus what the group has in ranges before.
    """
    keys = [F.col(k).asc_nulls_first() for k in [*group, *order, "_tie"]]
    parted = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    parted = stored(parted.withColumns({"_part": F.shiftright("_at", 33), "_pos": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_tie", "_at"))
    per = parted.groupBy(*group, "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group)
    before = F.sum("_c").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    per = stored(per.select(*group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_c").over(w).alias("n")))
    per = F.broadcast(per) if per.count() <= BROADCAST_ROWS else per
    return parted.join(per, [*group, "_part"]).withColumn("rank", F.col("_pos") + F.col("_shift")).drop("_part", "_pos", "_shift")
