"""Embedding whitening: covariance in two passes, symmetric eigenvectors, one projection.

An entry c of a vector becomes the integer ``x = floor(SCALE * c) + OFFSET``.  The first pass adds up
exact integers: the number of vectors and the sum of each dimension.  With these the second pass
centres every vector before it is multiplied, ``(n x - S) / n``, whose numerator is an exact integer,
and adds up outer products, one matrix product (GEMM) for each Arrow batch.  Partitions' sums are
merged by ``treeAggregate``, so the driver gets a few matrices of dimension squared, whatever the
number of vectors.  LAPACK's symmetric solver gives the components; they are broadcast (dimension
times ``COMPONENTS`` doubles) and each vector is projected where it lies.  A third pass measures what
came out: the covariance of the whitened vectors, each block centred by its own mean, against the
identity.  No step shuffles vectors, so no vector, however common, can make a task larger.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; repeated
rows and null ids stay, each with its own rows of the result; vectors of several lengths, and entries
whose integers aren't below 2**53 in size, are errors; an empty table gives no rows.  A component
without variance (its eigenvalue is not above rounding of the largest: always so for one vector) has
no whitened value (null) and doesn't count in ``identity_error``, which is null if there is no other;
``explained`` is null if the trace is 0.  Columns other than the id and the vector are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Integers are exact as doubles below this.
EXACT = 1 << 53


@dataclass
class Whitening:
    """What is learned from all vectors: their number, the sums of each dimension, and the components."""

    n: int
    sums: np.ndarray  # long
    vectors: np.ndarray  # dimension x components, unit columns, by falling eigenvalue
    values: np.ndarray  # eigenvalues of the components
    trace: float
    identity_error: float | None = None

    @property
    def live(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0), 0)


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a column of lists the rows that count, and their vectors as rows of integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.where(np.array(column.is_valid()), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(size)
    good = np.array(column.is_valid()) & (bad[ends] == bad[ends - size])
    rows = np.flatnonzero(good)
    if not len(rows):
        return rows, np.zeros((0, 0), np.int64)
    if len(set(size[rows].tolist())) > 1:
        raise ValueError("vectors of several lengths")
    x = np.floor(SCALE * flat[np.repeat(good, size)].reshape(len(rows), -1)) + OFFSET
    if np.abs(x).max(initial=0) >= EXACT:
        raise ValueError("an entry is too large for exact integers")
    return rows, x.astype(np.int64)


def _exact_sum(x: np.ndarray) -> list[int]:
    """Sums of columns as Python's integers, which don't overflow."""
    if np.abs(x).max(initial=0) < 1 << 40:  # a batch has fewer than 2**23 rows
        return [int(v) for v in x.sum(0)]
    return [sum(map(int, column)) for column in x.T]


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, from exact numerators where those are integers of 64 bits."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        return (n * x - sums.astype(np.int64)) / n
    return np.array([[float(n * int(v) - int(s)) / n for v, s in zip(row, sums, strict=True)] for row in x]).reshape(x.shape)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n x - S)**2, exact."""
    if n * int(np.abs(x).max(initial=0)) < 1 << 62:
        y = n * x - sums.astype(np.int64)
        if x.shape[1] * int(np.abs(y).max(initial=0)) ** 2 < 1 << 63:
            return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0))
    from decimal import Decimal

    return pa.array([Decimal(sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True))) for row in x], pa.decimal128(38, 0))


def _tree(partials: DataFrame, merge, depth: int = 2):
    """Partitions' sums, one binary row each, merged in a tree; None if there are none."""
    import pickle

    one = partials.rdd.map(lambda r: pickle.loads(bytes(r[0])))
    both = lambda a, b: b if a is None else a if b is None else merge(a, b)
    return one.treeAggregate(None, both, both, depth)


def _per_partition(rows: DataFrame, start, add) -> DataFrame:
    """One binary row of each partition: ``add`` folded over its batches' integer vectors."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for b in batches:
            own, x = integers(b.column(0))
            if len(own):
                state = add(state, x)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    return rows.select("_vector").mapInArrow(run, "state binary")


def _add_sums(a, b):
    if len(a[1]) != len(b[1]):
        raise ValueError("vectors of several lengths")
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """First pass: the number of vectors, and the exact sum of each dimension."""
    add = lambda s, x: (len(x), _exact_sum(x)) if s is None else _add_sums(s, (len(x), _exact_sum(x)))
    return _tree(_per_partition(rows, None, add), _add_sums) or (0, [])


def covariance(rows: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """Second pass: the covariance of all vectors, divisor n, from centred outer products."""

    def add(s, x):
        y = _centred(x, n, total)
        return y.T @ y if s is None else s + y.T @ y

    return _tree(_per_partition(rows, None, add), lambda a, b: a + b) / n


def _merge_moments(a, b):
    """Number, mean and centred products of two parts together."""
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def project(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Whitened vectors; a component without variance is NaN."""
    scale = np.where(w.live, np.sqrt(np.where(w.live, w.values, 1)), np.nan)
    return (_centred(x, w.n, w.sums) @ w.vectors) / scale


def check(rows: DataFrame, w: Whitening) -> float | None:
    """Third pass: the largest entry of the whitened vectors' covariance minus the identity."""
    if not w.live.any():
        return None

    def add(s, x):
        z = project(x, w)[:, w.live]
        mean = z.mean(0)
        z = z - mean
        own = (len(x), mean, z.T @ z)
        return own if s is None else _merge_moments(s, own)

    n, _, products = _tree(_per_partition(rows, None, add), _merge_moments)
    return float(np.abs(products / n - np.eye(len(products))).max())


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Components of all vectors of ``_vector``, and how near the whitened covariance is to the identity; None without vectors."""
    n, total = sums(rows)
    if not n:
        return None
    total = np.array(total, object)
    v = covariance(rows, n, total)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    w = Whitening(n, total, vectors[:, order], values[order], float(np.trace(v)))
    w.identity_error = check(rows, w)
    return w


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: the id, component, n, deviation (decimal), whitened, explained, identity_error."""
    rows = table.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("_vector"))
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [rows.schema["_id"].dataType, T.IntegerType(), T.LongType(), T.DecimalType(38, 0), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)])
    w = fit(rows, components)
    if w is None:
        return rows.sparkSession.createDataFrame([], schema).toDF(*names)
    sent = rows.sparkSession.sparkContext.broadcast(w)  # dimension x components, whatever the number of vectors
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        explained = w.values / w.trace if w.trace > 0 else np.full(k, np.nan)
        for b in batches:
            own, x = integers(b.column(1))
            if not len(own) or not k:
                continue
            m, each = len(own), pa.array(np.repeat(np.arange(len(own)), k))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(own)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)), _deviation(x, w.n, w.sums).take(each),
                pa.array(project(x, w).ravel(), from_pandas=True), pa.array(np.tile(explained, m), from_pandas=True), pa.array([w.identity_error] * (m * k), pa.float64()),
            ], schema.names)

    return rows.mapInArrow(run, schema).toDF(*names)
