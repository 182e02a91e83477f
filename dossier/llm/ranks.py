"""Positions in sorted groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.cuts import cut

PART_BITS = 33  # monotonically_increasing_id holds the partition above these bits, the row below


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """df with each row's position, from 0, in its group by order (nulls first), and its group's size.

    Rows are dealt to partitions by ranges of (group, order), so a group of any size spreads over many of them; a row's
    position is that in its partition plus the rows of its group in earlier partitions, of which there is one count for each
    group and partition. Group columns hold no nulls. Rows equal in all these columns are interchangeable; a scan's row number keeps
    many of them from meeting in one partition. df is read twice, for the ranges and for the rows: give a written table.
    """
    keys = [*group, *order]
    placed = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys, "_tie")
        .sortWithinPartitions(*keys, "_tie")
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = cut(placed, "ranked").withColumn("_part", F.shiftright("_at", PART_BITS))
    runs = placed.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_part", *group, "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias(size))
    placed = placed.join(runs, ["_part", *group])
    return placed.withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")
