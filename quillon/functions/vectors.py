"""Vector expressions over array<double>; arrays of other number types are cast."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a norm is 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def normalised(v: Column) -> Column:
    """Unit vector, or null where the norm is 0 or not a number."""
    n = norm(v)
    return F.when((n > 0) & ~F.isnan(n), F.transform(doubles(v), lambda x: x / n))


def euclidean(a: Column, b: Column) -> Column:
    """Distance; null where the lengths differ."""
    d = F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x)))


def valid(v: Column, size: int) -> Column:
    """Of the right length, without NaN, and not the zero vector."""
    return F.coalesce((F.size(v) == size) & ~F.exists(doubles(v), F.isnan) & (norm(v) > 0), F.lit(False))
