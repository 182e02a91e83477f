"""Comparing two snapshots, two runs or two schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(local: DataFrame, remote: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys and status of every row on either side: new, changed, unchanged or stale (remote only)."""
    a = local.select(*keys, *[F.col(c).alias(f"_l_{c}") for c in fields], F.lit(True).alias("_l"))
    b = remote.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in fields], F.lit(True).alias("_r"))
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}"))
    state = F.when(F.col("_r").isNull(), "new").when(F.col("_l").isNull(), "stale").when(same, "unchanged").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("status"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose non-null key has no row in parent."""
    return child.filter(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def missing_columns(df: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """Columns that df lacks, and those it has besides the expected ones."""
    return sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))


def set_changes(df: DataFrame, key: str, before: Column, after: Column) -> DataFrame:
    """key, value, change (+1 added, -1 removed) of array columns."""
    rows = lambda values, sign: F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(sign).alias("change")))
    return df.select(key, F.inline(F.concat(rows(F.array_except(after, before), 1), rows(F.array_except(before, after), -1))))


def run_changes(before: DataFrame, after: DataFrame, key: str, score: str, least: float = 0.001, most: int = 20) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Regressions (worst first), improvements (best first), and keys of only one run."""
    both = before.select(key, F.col(score).alias("before")).join(after.select(key, F.col(score).alias("after")), key).withColumn("delta", F.col("after") - F.col("before"))
    worse = both.filter(F.col("delta") < -least).orderBy("delta", key).limit(most)
    better = both.filter(F.col("delta") > least).orderBy(F.desc("delta"), key).limit(most)
    return worse, better, before.select(key).join(after, key, "left_anti"), after.select(key).join(before, key, "left_anti")
