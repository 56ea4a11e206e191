"""Weight kernels of a neighbour's distance and the distances to each end's last neighbour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kernels whose graphs are made symmetric by the maximum; all others by the mean.
MAX_SYMMETRIC = frozenset(["distance", "uniform", "singular", "symgaussian"])
NAMES = ("uniform", "gaussian", "symgaussian", "distance", "singular")


def weight(kernel: str | Callable[[Column], Column], dist: Column, own: Column, other: Column | None = None) -> Column:
    """Weight of an edge; ``own`` and ``other`` are the two ends' distances to their k-th neighbour.

    A callable kernel gets the squared distance over the squared ``own``.
    """
    if callable(kernel):
        return kernel(dist * dist / (own * own))
    if kernel == "uniform":
        return F.lit(1.0)
    if kernel == "gaussian":
        return F.exp(-4 * dist * dist / (own * own))
    if kernel == "symgaussian":
        return F.exp(-4 * dist * dist / (own * other))
    if kernel == "distance":
        return dist
    if kernel == "singular":
        return F.when(dist == 0, 1.0).otherwise(1 / dist)
    raise ValueError(f"unknown kernel {kernel!r}; known: {', '.join(NAMES)}")
