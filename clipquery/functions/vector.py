"""Vector functions as column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The vector over its length; null for a vector of length 0.

    The length is an element of an array, so that it is worked out once and not again for each component.
    """
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))), F.lit(0))


def similarity(distance: Column) -> Column:
    """exp(-d); 0 without a distance."""
    return F.coalesce(F.exp(-distance), F.lit(0.0))


def to_distance(score: Column) -> Column:
    return -F.ln(score + 1e-10)
