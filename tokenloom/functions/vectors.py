"""Column builders over arrays of numbers: products, norms and the similarities built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """a scaled to length one; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def abs_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x) * F.abs(y)), F.lit(0.0), lambda s, x: s + x)


def angular(c: Column) -> Column:
    """1 - arc cosine / pi of a cosine, clipped before the arc cosine."""
    return 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) / F.pi()


def shifted(c: Column) -> Column:
    return (c + 1) / 2
