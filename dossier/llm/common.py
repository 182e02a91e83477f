"""What the operators of this subpackage share: table access, folds, samples, row keys, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.cuts import cut  # noqa: F401  (for the operators)

#: A word in every contract of this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row, as far as their types have one: rows that differ in any get different keys."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id's decimal text, modulo k: the deterministic folds of the contracts. A null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % k, F.lit(0)).cast("int")


def in_sample(key: Column, bound: int, n: Column, seed: int = 7) -> Column:
    """Whether a row belongs to the about `bound` of n that a hash of key in 62 bits chooses: of any n some, of few all."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 2) < F.lit(2.0**62 * bound) / n


def bounded_sample(df: DataFrame, bound: int, key: Column, seed: int = 7) -> DataFrame:
    """About `bound` rows of df at most, chosen by a hash of key: the same rows on every run.

    One counting job sets the rate; a table within the bound is taken whole.
    """
    n = df.count()
    if n <= bound:
        return df
    return df.filter(in_sample(key, bound, F.lit(float(n)), seed))


def running(values: Column, combine, block: int = 128) -> Column:
    """Running totals of an array<bigint> column under an associative combine, 0 first: n + 1 values.

    Two levels (totals of blocks, then inside each block), so that long arrays need n * block steps, not n * n.
    """
    n = F.size(values)
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(n / block).cast("int") - 1, F.lit(0))),
        lambda b: F.slice(values, b * block + 1, block),
    )
    zero = F.lit(0).cast("bigint")
    grow = lambda acc, x: F.array_append(acc, combine(F.element_at(acc, -1), x))
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, combine))
    starts = F.aggregate(totals, F.array(zero), grow)
    inner = F.zip_with(
        blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda b, s: F.aggregate(F.slice(b, 1, F.size(b) - 1), F.array(s), grow)
    )
    return F.when(n == 0, F.array(zero)).otherwise(F.concat(F.flatten(inner), F.array(F.element_at(starts, -1))))


def prefix_sums(values: Column) -> Column:
    return running(values, lambda a, x: a + x)
