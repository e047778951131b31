"""Vector arithmetic as columns over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def with_norm(v: Column, f) -> Column:
    """f(vector, norm), both computed once a row and not once an element."""
    return bound(v, lambda w: bound(F.struct(w.alias("v"), norm(w).alias("n")), lambda s: f(s["v"], s["n"])))


def safe_normalize(v: Column) -> Column:
    """Divided by the norm plus a small constant: a zero vector stays zero."""
    return with_norm(v, lambda w, n: F.transform(w, lambda x: x / (n + EPSILON)))


def unit(v: Column) -> Column:
    """Divided by the norm where that is above 0, else unchanged."""
    return with_norm(v, lambda w, n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def to_similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def score(metric: str, a: Column, b: Column, similarity: bool = True) -> Column:
    """Score by metric name; an unknown name raises ValueError."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "euclidean":
        return to_similarity(euclidean(a, b)) if similarity else euclidean(a, b)
    raise ValueError(f"unknown metric: {metric}")


def time_score(gap: Column, max_gap: float = 300.0, scale: float = 60.0) -> Column:
    """Decay of a time gap in seconds; 0 beyond the largest gap."""
    return F.when(gap > max_gap, F.lit(0.0)).otherwise(F.exp(-gap / scale))


def rounded(x: Column, places: int) -> Column:
    """``F.round`` of doubles, halves away from zero, by arithmetic where a long holds the digits: of billions of rows, decimals take most of the time."""
    unit = 10.0**places
    near = F.when(x < 0, -F.floor(-x * unit + 0.5)).otherwise(F.floor(x * unit + 0.5)) / unit
    return F.when(F.abs(x) * unit < 1e15, near).otherwise(F.round(x, places))
