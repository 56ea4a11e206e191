"""Distances between array columns, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(_sum(F.transform(x, lambda a: a * a)))


def unit(x: Column, least: float = 1e-20) -> Column:
    """The vector over its length, which counts as ``least`` at least."""
    n = F.greatest(norm(x), F.lit(least))
    return F.transform(x, lambda a: a / n)


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def angular(x: Column, y: Column) -> Column:
    """Euclidean distance of the two unit vectors, not the angle."""
    return euclidean(unit(x), unit(y))


def manhattan(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def hamming(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: F.when(a != b, 1.0).otherwise(0.0)))


DISTANCES = {"euclidean": euclidean, "angular": angular, "manhattan": manhattan, "hamming": hamming}
