"""Array expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def argmax(a: Column) -> Column:
    """0-based position of the largest entry; the first one wins on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(a: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / total(e))


def label_position(labels: Column, label: Column) -> Column:
    """0-based class index in a sorted class list."""
    return (F.array_position(labels, label) - 1).cast("int")


def doubles(a: str | Column) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("array<double>")


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
