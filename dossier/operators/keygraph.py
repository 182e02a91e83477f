"""Tables that refer to each other: the order in which they may be emptied, wipes that can be taken up again, and orphans.

A library is stored with each table in ranges of keys (folders `range=k`). A wipe goes through the layers of the key graph,
tables that nothing refers to first, range by range. A range is gone once the progress table names it, one small file a step, so
a wipe that is interrupted goes on where it stopped, and at no point does a row refer to one that is gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGES = 16


@dataclass(frozen=True)
class Edge:
    """child.column holds a key of parent (or null)."""

    child: str
    column: str
    parent: str
    key: str


def layers(tables: list[str], edges: list[Edge]) -> list[list[str]]:
    """Tables in the order of deletion: each layer's are referred to by earlier layers only. A reference to the own table does not count."""
    out, left = [], sorted(tables)
    while left:
        held = {e.parent for e in edges if e.child in left and e.child != e.parent}
        free = [t for t in left if t not in held]
        if not free:
            raise ValueError(f"References in a circle among {', '.join(left)}")
        out.append(free)
        left = [t for t in left if t in held]
    return out


def orphans(tables: dict[str, DataFrame], edges: list[Edge]) -> DataFrame:
    """child, column, parent, orphans: rows of each reference whose key no parent row has."""

    def of(e: Edge) -> DataFrame:
        parents = tables[e.parent].select(F.col(e.key).alias("_key")).distinct()
        lost = tables[e.child].filter(F.col(e.column).isNotNull()).select(F.col(e.column).alias("_key")).join(parents, "_key", "left_anti")
        return lost.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(e.child).alias("child"), F.lit(e.column).alias("column"), F.lit(e.parent).alias("parent"), "orphans")

    return reduce(DataFrame.unionByName, map(of, edges))


class Library:
    """Tables under a path, each with its key, in RANGES ranges."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], edges: list[Edge], ranges: int = RANGES):
        self.spark, self.path, self.keys, self.edges, self.ranges = spark, path, keys, edges, ranges

    def store(self, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            placed = df.withColumn("range", F.pmod(F.xxhash64(self.keys[name]), F.lit(self.ranges)).cast("int"))
            placed.repartition("range", F.pmod(F.xxhash64(self.keys[name], F.lit(1)), F.lit(4))).write.partitionBy("range").parquet(f"{self.path}/tables/{name}")
        self._say([])

    def _say(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, "layer int, name string, range int, rows bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/progress")

    def progress(self) -> DataFrame:
        """layer, name, range, rows of the ranges that are gone."""
        return self.spark.read.parquet(f"{self.path}/progress")

    def read(self, name: str) -> DataFrame:
        """What is left of a table: the folders of ranges that are gone are not listed."""
        gone = [r["range"] for r in self.progress().filter(F.col("name") == name).select("range").distinct().collect()]
        return self.spark.read.parquet(f"{self.path}/tables/{name}").filter(~F.col("range").isin(gone)).drop("range")

    def steps(self) -> Iterator[tuple[int, str, int]]:
        """What a wipe has still to do, in order."""
        gone = {(r["name"], r["range"]) for r in self.progress().select("name", "range").collect()}  # RANGES rows a table at most
        for k, names in enumerate(layers(list(self.keys), self.edges)):
            for name in names:
                yield from ((k, name, r) for r in range(self.ranges) if (name, r) not in gone)

    def wipe(self, most_steps: int | None = None) -> int:
        """Goes on with the wipe, for most_steps steps or to its end; the number of steps done."""
        done = 0
        for layer, name, r in self.steps():
            if done == most_steps:
                break
            rows = self.spark.read.parquet(f"{self.path}/tables/{name}").filter(F.col("range") == r).count()
            self._say([(layer, name, r, rows)])
            done += 1
        return done
