"""Columns on arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 if the lengths differ or a vector is null, empty or zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def vector(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")
