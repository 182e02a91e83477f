"""Latest rows, gaps, runs, first appearances and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(df: DataFrame, key: list[str], at: str, minutes: float) -> DataFrame:
    """Adds session: 1, 2, ... per key, a new one after each gap of over `minutes`."""
    order = Window.partitionBy(*key).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    new = F.coalesce(seconds - F.lag(seconds).over(order) > minutes * 60, F.lit(True)).cast("int")
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def last_run(df: DataFrame, key: list[str], at: str, minutes: float) -> DataFrame:
    """Per key (none: of all rows) the latest session: its start, end, number of rows and seconds.

    A session ends at the last gap of over `minutes` before it. Time is cut into slots of that length, so a gap spans at
    least one whole slot boundary: rows are first reduced to the earliest and latest time and the number of each slot, and
    only slots are put in order. No task orders the rows of a key.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = int(minutes * 60 * 1_000_000)
    slots = df.filter(F.col(at).isNotNull()).groupBy(*key, F.floor(micros / max(gap, 1)).alias("_slot"))
    slots = slots.agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.min(micros).alias("_from"), F.max(micros).alias("_to"), F.count("*").alias("_rows"))
    # inside a slot of the gap's length no two rows are further apart than the gap
    back = Window.partitionBy(*key).orderBy(F.desc("_slot"))
    broken = F.coalesce(F.lag("_from").over(back) - F.col("_to") > gap, F.lit(False)).cast("int")
    newest = slots.withColumn("_new", broken).withColumn("_later", F.sum("_new").over(back.rowsBetween(Window.unboundedPreceding, 0))).filter("_later = 0")
    out = newest.groupBy(*key).agg(F.min("_first").alias("started"), F.max("_last").alias("ended"), F.sum("_rows").alias("rows"), F.min("_from").alias("_a"), F.max("_to").alias("_b"))
    return out.filter("rows is not null").select(*key, "started", "ended", "rows", ((F.col("_b") - F.col("_a")) / 1e6).alias("seconds"))


def first_seen_index(df: DataFrame, by: list[str], group: str, position: str) -> DataFrame:
    """Adds index: 1 for the group that appears first within `by`, 2 for the next, and so on."""
    first = F.min(position).over(Window.partitionBy(*by, group))
    return df.withColumn("_first", first).withColumn("index", F.dense_rank().over(Window.partitionBy(*by).orderBy("_first"))).drop("_first")


def newest(df: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")


def surplus(df: DataFrame, by: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The rows that newest() leaves out: duplicates to delete."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") > keep).drop("_n")


def running_offsets(parts: Column, separator: int = 2) -> Column:
    """Start of each text of an array when they are joined by a separator of that length."""
    none = F.array().cast("array<struct<at:int,next:int>>")
    step = lambda acc, p: F.array_append(acc, F.struct(F.coalesce(F.element_at(acc, -1)["next"], F.lit(0)).alias("at"), (F.coalesce(F.element_at(acc, -1)["next"], F.lit(0)) + F.length(p) + separator).alias("next")))
    safe = lambda acc, p: F.when(F.size(acc) > 0, step(acc, p)).otherwise(F.array(F.struct(F.lit(0).alias("at"), (F.length(p) + separator).alias("next"))))
    return F.transform(F.aggregate(parts, none, safe), lambda x: x["at"])
