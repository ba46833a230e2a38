"""Vector expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUND_RANK = 9
ROUND_OUT = 6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column = None, norm_b: Column = None) -> Column:
    """Cosine of two vectors, null when either has no direction (zero norm) or is null."""
    norm_a = l2_norm(a) if norm_a is None else norm_a
    norm_b = l2_norm(b) if norm_b is None else norm_b
    return F.try_divide(dot(a, b), norm_a * norm_b)


def cosine_distance(a: Column, b: Column, norm_a: Column = None, norm_b: Column = None) -> Column:
    return F.lit(1.0) - cosine(a, b, norm_a, norm_b)


def similarity(distance: Column) -> Column:
    """Distance to similarity within 0..1; NaN and null stay what they are, never a match.

    (Spark's greatest and least skip nulls, which would make a null distance a perfect match.)
    """
    raw = F.lit(1.0) - distance
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return F.when(raw.isNull() | F.isnan(raw), raw).otherwise(clamped)


def passes_floor(score: Column, floor: Column) -> Column:
    """score >= floor, false for NaN (which Spark orders above every number)."""
    return ~F.isnan(score) & (score >= floor)
