"""Vectors as array columns: exact sums in double precision, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZERO = 0.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(_ZERO), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(_ZERO), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(_ZERO))


def clamped_cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b)))


def flaw(a: Column) -> Column:
    """Why a vector cannot be searched: missing, non_finite or zero; null if it can."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(a.isNull() | (F.size(a) == 0), "missing").when(bad, "non_finite").when(F.forall(a, lambda x: x == 0), "zero")


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
