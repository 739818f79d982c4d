"""Vectors and class scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, metric: str) -> Column:
    """Cosine (0 for a zero vector), euclidean (negative distance) or dot."""
    if metric == "cosine":
        return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    if metric == "euclidean":
        return -F.sqrt(total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))
    if metric == "dot":
        return dot(a, b)
    raise ValueError(metric)


def softmax(logits: Column) -> Column:
    """P47."""
    e = F.transform(_double(logits), lambda x: F.exp(x - F.array_max(_double(logits))))
    return F.transform(e, lambda x: x / total(e))


def argmax(v: Column) -> Column:
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def above_half(logits: Column) -> Column:
    """Places whose sigmoid is over one half."""
    return F.filter(F.transform(logits, lambda x, i: F.when(1 / (1 + F.exp(-x)) > 0.5, i)), lambda i: i.isNotNull())


def normalised(v: Column) -> Column:
    """P48."""
    n = norm(v)
    return F.transform(_double(v), lambda x: F.when(n > 0, x / n).otherwise(x))
