"""Dense vectors and score scales as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero vector; an error for vectors of different length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; values that are all the same become 1 if positive, else 0."""
    same = F.abs(high - low) <= F.greatest(1e-9 * F.greatest(F.abs(high), F.abs(low)), F.lit(1e-12))
    return F.when(same, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))


def min_max(value: Column, window: WindowSpec | None = None) -> Column:
    window = window or Window.partitionBy()
    return scaled(value, F.min(value).over(window), F.max(value).over(window))


def fused(lexical: Column, semantic: Column, lexical_weight: float = 0.4, semantic_weight: float = 0.6) -> Column:
    """Weighted mean of two scaled scores; the lexical one alone where there is no semantic one."""
    if min(lexical_weight, semantic_weight) < 0 or lexical_weight + semantic_weight <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    mean = (lexical_weight * lexical + semantic_weight * semantic) / (lexical_weight + semantic_weight)
    return F.coalesce(mean, lexical)
