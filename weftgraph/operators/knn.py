"""Nearest neighbours of all points: exact by pivot cells, or by a forest of random projections.

Points are (id, x array<double>).  Both plans return (src, dst, dist, rank) with ranks from 1 and
without the point itself, ties broken by id.  The exact search is what is done unless the forest is
asked for by name, at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.fixpoint import cut

#: Points that are searched in one block, and in a larger table a quarter of which makes a cell.
BLOCK = 2048
#: Blocks of a larger table (some of them), the bytes of points at which there are more, and points that ask at a time.
GROUPS, BYTES, TILE = 16, 32 << 20, 512
#: Pivots of the exact search (a bounded sample; their cells leave out what is far).
PIVOTS = 4096
#: Trees, points in a leaf, and points that the trees' splits are drawn from (a bounded sample).
TREES, LEAF, SAMPLE = 10, 512, 20_000
SIMILARITIES = ("euclidean", "angular", "manhattan", "hamming", "dot")


def _distances(a: np.ndarray, b: np.ndarray, similarity: str) -> np.ndarray:
    if similarity == "dot":
        return -(a @ b.T)
    if similarity in ("manhattan", "hamming"):
        out = np.empty((len(a), len(b)))
        step = max(1, (1 << 22) // max(1, b.size))
        for i in range(0, len(a), step):
            gap = a[i : i + step, None, :] - b[None]
            out[i : i + step] = np.abs(gap).sum(2) if similarity == "manhattan" else (gap != 0).sum(2)
        return out
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _within(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs within a bound of each of a, and some beyond, by one product in single precision with room for its rounding; nothing if that tells too few apart."""
    middle = b.mean(0)
    a, b = a - middle, b - middle
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    reach = bound + 1e-9 * np.abs(bound) + 1e-9
    room = 2.5e-7 * (a.shape[1] + 16) * (a2 + b2.max(initial=0)) + 1e-30
    if not np.isfinite(room).all() or room.max(initial=0) > 1e30:
        return None
    near = a.astype(np.float32) @ b.astype(np.float32).T
    near -= (b2 / 2).astype(np.float32)
    near = near >= ((a2 - reach * reach) / 2 - room).astype(np.float32)[:, None]
    at = np.flatnonzero(near)
    return None if len(at) > 64 * len(a) + 4096 else np.divmod(at, near.shape[1])


@dataclass
class _Coded:
    """Two sets of points as small integers: ``a`` and ``b`` by bit or coordinate, word, and point; and the length of a unit of them."""

    a: np.ndarray
    b: np.ndarray
    unit: float

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, similarity: str) -> _Coded | None:
        """Hamming: the bits of coordinates that are whole numbers, 64 coordinates a word.  Manhattan: coordinates in units that let a sum of them fit 16 bits.  Nothing where that can't be done."""
        dims = a.shape[1]
        if similarity not in ("hamming", "manhattan") or not dims or not len(a) or not len(b) or not (np.isfinite(a).all() and np.isfinite(b).all()):
            return None
        low = np.minimum(a.min(0), b.min(0))
        span = float((np.maximum(a.max(0), b.max(0)) - low).max())
        if similarity == "hamming":
            if span > 255 or not all((x == np.floor(x)).all() for x in (a, b)):
                return None
            bits = max(1, int(span).bit_length())

            def words(x: np.ndarray) -> np.ndarray:
                x = np.pad((x - low).astype(np.uint8), ((0, 0), (0, -dims % 64)))
                return np.stack([np.ascontiguousarray(np.packbits((x >> p) & 1, axis=1).view(np.uint64).T) for p in range(bits)])

            return cls(words(a), words(b), 1.0)
        most = 65535 // dims
        if most < 512 or not span > 0:
            return None
        unit = span / most
        return cls(*(np.ascontiguousarray(np.minimum(np.rint((x - low) / unit), most).astype(np.uint16).T)[None] for x in (a, b)), unit)

    def some(self, a: slice, b: np.ndarray | slice) -> _Coded:
        return _Coded(self.a[:, :, a], self.b[:, :, b], self.unit)

    def within(self, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs within a bound of each of a; for Manhattan distances also some beyond."""
        n, m = self.a.shape[2], self.b.shape[2]
        step, found = max(1, (1 << 17) // max(1, m)), []
        wide = self.a.dtype == np.uint16
        room = self.a.shape[1] + 2 if wide else 0  # half a unit is lost by each coordinate of each point
        most = np.minimum(np.floor((bound + 1e-9 * np.abs(bound) + 1e-9) / self.unit) + room, 65535).astype(np.uint16)
        sums, sums_b = (v.sum((0, 1), dtype=np.uint64).astype(np.uint16) for v in (self.a, self.b)) if wide else (None, None)
        for at in range(0, n, step):
            part = self.a[:, :, at : at + step]
            d = np.zeros((part.shape[2], m), np.uint16)
            if wide:  # |x - y| = 2 max(x, y) - x - y; what passes 16 bits on the way cancels
                more = np.empty_like(d)
                for x, y in zip(part[0], self.b[0], strict=True):
                    more[:] = x[:, None]  # of one length, which the processor takes many at a time
                    np.maximum(more, y, out=more)
                    d += more
                d += d
                d -= sums_b
                d -= sums[at : at + step, None]
            else:
                for w in range(part.shape[1]):
                    off = part[0, w][:, None] ^ self.b[0, w]
                    for p in range(1, len(part)):
                        off |= part[p, w][:, None] ^ self.b[p, w]
                    d += np.bitwise_count(off)
            found.append(np.flatnonzero(d <= most[at : at + step, None]) + at * m)
        return np.divmod(np.concatenate(found), m) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _direct(a: np.ndarray, src: np.ndarray, b: np.ndarray, dst: np.ndarray, similarity: str) -> np.ndarray:
    """Distances of pairs, some at a time."""
    out = np.empty(len(src))
    for i in range(0, len(src), 1 << 15):
        x, y = a[src[i : i + (1 << 15)]], b[dst[i : i + (1 << 15)]]
        gap = x - y
        out[i : i + (1 << 15)] = {"dot": lambda: -(x * y).sum(1), "manhattan": lambda: np.abs(gap).sum(1), "hamming": lambda: (gap != 0).sum(1)}.get(similarity, lambda: np.sqrt((gap * gap).sum(1)))()
    return out


def nearest(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, k: int, similarity: str, kth: np.ndarray | None = None, coded: _Coded | None = None) -> pd.DataFrame:
    """The k nearest of b for each of a (no farther than a bound each, if given), without itself; distances of those chosen are computed directly."""
    if similarity == "angular":
        a, b = (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-20) for x in (a, b))
    known = kth is not None and bool(np.isfinite(kth).all())
    some = coded.within(kth) if known and coded else _within(a, b, kth) if known and similarity in ("euclidean", "angular") else None
    if some is None:
        d = _distances(a, b, similarity)
        d[ids_a[:, None] == ids_b[None]] = np.inf
        last = kth if known else np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        last = last if kth is None else np.minimum(last, kth)
        # all ties of the last one, and what rounding may have put behind it; the direct distances decide
        src, dst = np.nonzero((d <= (last + 1e-9 * np.abs(last) + 1e-9)[:, None]) & np.isfinite(d))
    else:
        src, dst = some
        other = ids_a[src] != ids_b[dst]
        src, dst = src[other], dst[other]
    exact = _direct(a, src, b, dst, similarity)
    order = np.lexsort((ids_b[dst], exact, src))
    src, dst, exact = src[order], dst[order], exact[order]
    rank = np.arange(len(src)) - np.searchsorted(src, src)
    top = rank < k if kth is None else (rank < k) & (exact <= kth[src])
    return pd.DataFrame({"src": ids_a[src[top]], "dst": ids_b[dst[top]], "dist": exact[top]})


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), np.float64) if len(x) else np.zeros((0, 0))


def _ranked(found: DataFrame, k: int, similarity: str) -> DataFrame:
    w = Window.partitionBy("src").orderBy("dist", "dst")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("dist", -F.col("dist")) if similarity == "dot" else out


def _arrays(ids: pa.ChunkedArray | pa.Array, x: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    n = len(x)
    return ids.to_numpy(), x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _geometry(x: np.ndarray, similarity: str, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Points as they lie and as they ask, in a metric whose order is that of the similarity.

    For dot, one coordinate more gives all points the norm ``most``, so that the greatest product is the
    least distance from the asking point, whose further coordinate is 0.
    """
    if similarity == "angular":
        y = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-20)
        return y, y
    if similarity == "dot":
        rest = np.sqrt(np.maximum(most * most - (x * x).sum(1, keepdims=True), 0))
        return np.concatenate([x, rest], 1), np.concatenate([x, 0 * rest], 1)
    return x, x


def _measure(a: np.ndarray, b: np.ndarray, similarity: str) -> np.ndarray:
    return _distances(a, b, similarity if similarity in ("manhattan", "hamming") else "euclidean")


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


@dataclass
class _Cells:
    """Pivots, and of each one's cell how many points it has and how near and far they lie."""

    pivots: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    group: np.ndarray  # of each cell
    chunks: np.ndarray  # blocks of each group

    def wanted(self, query: np.ndarray, bound: np.ndarray, similarity: str, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Cells (or some of them) that the triangle inequality can't exclude, for each query and its bound of the k-th distance."""
        d = _measure(query, self.pivots[some], similarity)
        least = np.maximum(d - self.high[some], self.low[some] - d)
        return (least <= (bound * (1 + 1e-9) + 1e-7)[:, None]) & (self.count[some] > 0)


def _search(cells: _Cells, ids: np.ndarray, x: np.ndarray, kth: np.ndarray, ids_b: np.ndarray, b: np.ndarray, cell_b: np.ndarray, k: int, similarity: str, most: float) -> tuple[list[pd.DataFrame], int]:
    """Neighbours of some points, no farther than their bounds, among a block sorted by cell; and how many pairs were compared.

    Some points at a time meet the cells of the block that any of them can't exclude.
    """
    found, pairs = [], 0
    here, first = np.unique(cell_b, return_index=True)
    ends = np.append(first[1:], len(cell_b))
    rows = min(TILE, max(1, (1 << 23) // max(1, len(b))))
    coded = _Coded.of(x, b, similarity)
    for i in range(0, len(ids), rows):
        part = slice(i, i + rows)
        need = cells.wanted(_geometry(x[part], similarity, most)[1], _bound(x[part], kth[part], similarity, most), similarity, here).any(0)
        if not need.any():
            continue
        some = slice(None) if need.all() else np.concatenate([np.arange(s, e) for s, e in zip(first[need], ends[need], strict=True)])
        pairs += len(ids[part]) * len(ids_b[some])
        found.append(nearest(ids[part], x[part], ids_b[some], b[some], k, similarity, kth[part], coded and coded.some(part, some)))
    return found, pairs


def _bound(x: np.ndarray, kth: np.ndarray, similarity: str, most: float) -> np.ndarray:
    """The k-th distance in the metric of the cells; infinite where it isn't known."""
    if similarity != "dot":
        return kth
    return np.where(np.isfinite(kth), np.sqrt(np.maximum((x * x).sum(1) + most * most + 2 * np.where(np.isfinite(kth), kth, 0), 0)), np.inf)


def _kth(found: list[pd.DataFrame], ids: np.ndarray, k: int, kth: np.ndarray) -> np.ndarray:
    """The bounds after what was found; ids are sorted, and a point's neighbours come in the order of distance."""
    kth = kth.copy()
    for f in found:
        src = np.searchsorted(ids, f["src"].to_numpy())
        last = np.full(len(ids), np.inf)
        last[src] = f["dist"].to_numpy()  # the last one stays
        held = np.bincount(src, minlength=len(ids)) >= k
        kth[held] = np.minimum(kth[held], last[held])
    return kth


def knn_exact(points: DataFrame, k: int, similarity: str = "euclidean", n: int | None = None, stats: dict | None = None) -> DataFrame:
    """Exact neighbours by pivot cells: a point meets its own block, and then only cells that may hold a nearer one.

    A bounded sample of points (``PIVOTS`` at most) are pivots; each point lies in the cell of the
    nearest.  Cells near each other make a group, and large groups are cut into blocks, some ``GROUPS`` in
    all whatever the number of points (more where one would take over ``BYTES``).  Within its own block a
    point gets a bound of its k-th distance; a cell whose nearest possible point is farther is left
    out.  Points that ask are sent once to each block with a cell that they need, so that what is sent
    grows as the points do, and the k best of all are kept.  No points but the pivots come to the
    driver.  Where distances are all alike (random points of many dimensions) nothing can be left out
    and the comparisons are quadratic; ``stats`` gets the share of pairs compared and the number of blocks.
    """
    spark = points.sparkSession
    points = points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    n = n if n is not None else points.count()
    norms = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    most = float(np.sqrt(points.agg(F.max(norms)).first()[0] or 0.0)) if similarity == "dot" else 0.0
    want = min(PIVOTS, 4 * -(-n // BLOCK)) if n > BLOCK else 1
    _, x = _arrays(*points.orderBy(F.xxhash64("id"), "id").limit(want).toArrow().select(["id", "x"]).columns)
    pivots = _geometry(x, similarity, most)[0]
    size = max(BLOCK, min(-(-n // GROUPS), BYTES // (8 * max(1, x.shape[1]))))
    group = _measure(pivots, pivots[:GROUPS], similarity).argmin(1) if len(pivots) else np.zeros(0, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                d = _measure(_geometry(_arrays(part.column(0), part.column(1))[1], similarity, most)[0], pivots, similarity)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], ["id", "x", "cell", "r"])

    placed = points.mapInArrow(assign, "id long, x array<double>, cell int, r double")
    placed = cut(placed) if n > BLOCK else placed
    about = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()  # a row for each pivot
    count, low, high = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in about:
        count[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    chunks = np.maximum(1, -(-np.bincount(group, count, minlength=1).astype(np.int64) // size))
    cells = spark.sparkContext.broadcast(_Cells(pivots, count, low, high, group, chunks))
    listed = lambda v: F.array(*[F.lit(int(c)) for c in (v if len(v) else [0])])
    placed = placed.withColumn("grp", F.element_at(listed(group), F.col("cell") + 1))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.element_at(listed(chunks), F.col("grp") + 1)).cast("int"))

    def own(t: pa.Table) -> pa.Table:
        """A block: its points, what it found of each point's neighbours, and which groups each must ask."""
        ids, x = _arrays(t.column("id"), t.column("x"))
        cell = t.column("cell").to_numpy()
        order = np.lexsort((ids, cell))
        ids, x, cell = ids[order], x[order], cell[order]
        by_id = np.argsort(ids)
        kth = np.full(len(ids), np.inf)
        # a bound from the own cell, and with it the rest of the block
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        pairs = 0
        if len(first) > 1:
            for s, e in zip(first, np.append(first[1:], len(ids)), strict=True):
                for i in range(s, e, TILE):
                    f = nearest(ids[i : min(i + TILE, e)], x[i : min(i + TILE, e)], ids[s:e], x[s:e], k, similarity)
                    kth[by_id] = _kth([f], ids[by_id], k, kth[by_id])
                    pairs += (min(i + TILE, e) - i) * (e - s)
        found, more = _search(cells.value, ids, x, kth, ids, x, cell, k, similarity, most)
        kth[by_id] = _kth(found, ids[by_id], k, kth[by_id])
        found = pd.concat(found, ignore_index=True) if found else pd.DataFrame({"src": ids[:0], "dst": ids[:0], "dist": kth[:0]})
        to, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(ids), TILE):
            need = cells.value.wanted(_geometry(x[i : i + TILE], similarity, most)[1], _bound(x[i : i + TILE], kth[i : i + TILE], similarity, most), similarity)
            a, c = np.nonzero(np.stack([need[:, group == g].any(1) for g in range(len(chunks))], 1))
            to.append(c)
            rows.append(a + i)
        to, rows = np.concatenate(to), np.concatenate(rows)
        by = np.argsort(to, kind="stable")
        return pa.table({
            "grp": pa.array([t.column("grp")[0].as_py()], pa.int32()), "chunk": pa.array([t.column("chunk")[0].as_py()], pa.int32()), "pairs": pa.array([int(pairs + more)], pa.int64()), "ids": pa.array([_pack(ids)], pa.binary()), "xs": pa.array([_pack(x)], pa.binary()), "cells": pa.array([_pack(cell.astype(np.int32))], pa.binary()), "kth": pa.array([_pack(kth)], pa.binary()),
            "src": pa.array([_pack(found["src"].to_numpy(np.int64))], pa.binary()), "dst": pa.array([_pack(found["dst"].to_numpy(np.int64))], pa.binary()), "dist": pa.array([_pack(found["dist"].to_numpy(np.float64))], pa.binary()), "to": pa.array([_pack(to[by].astype(np.int32))], pa.binary()), "rows": pa.array([_pack(rows[by].astype(np.int32))], pa.binary()),
        })

    blocks = placed.groupBy("grp", "chunk").applyInArrow(own, "grp int, chunk int, pairs long, ids binary, xs binary, cells binary, kth binary, src binary, dst binary, dist binary, to binary, rows binary")
    blocks = cut(blocks) if n > BLOCK else blocks
    read = lambda b, name, i, kind: np.frombuffer(b.column(name)[i].as_buffer(), kind)
    listed = lambda src, dst, dist: pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(dist)], ["src", "dst", "dist"])

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield listed(read(b, "src", i, np.int64), read(b, "dst", i, np.int64), read(b, "dist", i, np.float64))

    found = blocks.select("src", "dst", "dist").mapInArrow(firsts, "src long, dst long, dist double")
    if n > BLOCK:

        def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["tgrp", "tchunk", "qids", "qxs", "qkth"]
            for b in batches:
                for i in range(b.num_rows):
                    ids, kth, to, rows = read(b, "ids", i, np.int64), read(b, "kth", i, np.float64), read(b, "to", i, np.int32), read(b, "rows", i, np.int32)
                    x, mine = read(b, "xs", i, np.float64).reshape(len(ids), -1), (b.column("grp")[i].as_py(), b.column("chunk")[i].as_py())
                    edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else []
                    for s, e in zip(edges, edges[1:], strict=False):
                        some, c = rows[s:e], int(to[s])
                        for chunk in range(int(cells.value.chunks[c])):
                            if (c, chunk) != mine:
                                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([chunk], pa.int32()), *[pa.array([_pack(v[some])], pa.binary()) for v in (ids, x, kth)]], names)

        asks = blocks.select("grp", "chunk", "ids", "xs", "kth", "to", "rows").mapInArrow(asking, "tgrp int, tchunk int, qids binary, qxs binary, qkth binary")
        met = asks.join(blocks.select(F.col("grp").alias("tgrp"), F.col("chunk").alias("tchunk"), "ids", "xs", "cells"), ["tgrp", "tchunk"]).select("qids", "qxs", "qkth", "ids", "xs", "cells")

        def searched(b: pa.RecordBatch, i: int) -> tuple[list[pd.DataFrame], int]:
            qids, kth, ids = read(b, "qids", i, np.int64), read(b, "qkth", i, np.float64), read(b, "ids", i, np.int64)
            return _search(cells.value, qids, read(b, "qxs", i, np.float64).reshape(len(qids), -1), kth, ids, read(b, "xs", i, np.float64).reshape(len(ids), -1), read(b, "cells", i, np.int32), k, similarity, most)

        def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    for got in searched(b, i)[0]:
                        yield listed(got["src"].to_numpy(), got["dst"].to_numpy(), got["dist"].to_numpy(np.float64))

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([searched(b, i)[1] for i in range(b.num_rows)], pa.int64())], ["pairs"])

        if stats is not None:
            stats["blocks"] = blocks.count()
            stats["share"] = ((met.mapInArrow(compared, "pairs long").agg(F.sum("pairs")).first()[0] or 0) + (blocks.agg(F.sum("pairs")).first()[0] or 0)) / n**2
        found = found.unionByName(met.mapInArrow(answers, "src long, dst long, dist double"))
    elif stats is not None:
        stats["share"] = 1.0
    return _ranked(found, k, similarity)


def _forest(sample: np.ndarray, leaf: int, seed: int) -> list[list[tuple[np.ndarray, float]]]:
    """Trees of median splits along random directions, each as its levels' (direction, thresholds) in heap order."""
    rng, trees = np.random.default_rng(seed), []
    for _ in range(TREES):
        nodes: dict[int, tuple[np.ndarray, float]] = {}
        todo = [(1, np.arange(len(sample)))]
        while todo:
            at, own = todo.pop()
            if len(own) <= leaf:
                continue
            pair = sample[rng.choice(own, 2, replace=False)]
            way = pair[0] - pair[1]
            way = way if np.any(way) else rng.normal(size=sample.shape[1])
            height = sample[own] @ way
            middle = float(np.median(height))
            left = height <= middle
            if left.all() or not left.any():
                continue
            nodes[at] = (way, middle)
            todo += [(2 * at, own[left]), (2 * at + 1, own[~left])]
        trees.append(nodes)
    return trees


def knn_forest(points: DataFrame, k: int, similarity: str = "euclidean", n: int | None = None, seed: int = 0) -> DataFrame:
    """Approximate neighbours: candidates share a leaf of one of ten trees; distances are exact.

    Splits come from a bounded sample; every point is placed.  A leaf that holds many more points
    than its share (equal points fall together) is searched in blocks, like the exact search.
    """
    n = n if n is not None else points.count()
    spark = points.sparkSession
    drawn = points.orderBy(F.xxhash64("id", F.lit(seed))).limit(SAMPLE).toPandas().sort_values("id")
    sample = _matrix(drawn["x"])
    if similarity == "angular" and len(sample):
        sample = sample / np.maximum(np.sqrt((sample * sample).sum(1, keepdims=True)), 1e-20)
    trees = spark.sparkContext.broadcast(_forest(sample, max(k + 1, int(LEAF * min(1.0, len(sample) / max(1, n)))), seed))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["x"])
            if not len(x):
                continue
            y = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-20) if similarity == "angular" else x
            for t, nodes in enumerate(trees.value):
                at = np.ones(len(x), np.int64)
                live = np.array([a in nodes for a in at])
                while live.any():
                    for node in np.unique(at[live]):
                        own = np.flatnonzero(at == node)
                        way, middle = nodes[int(node)]
                        at[own] = 2 * node + (y[own] @ way > middle)
                    live = np.array([int(a) in nodes for a in at])
                yield pd.DataFrame({"id": b["id"], "x": b["x"], "tree": t, "leaf": at})

    placed = points.select("id", "x").mapInPandas(place, "id long, x array<double>, tree int, leaf long")
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (4 * LEAF)).cast("int").alias("parts"))
    placed = placed.join(sizes, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    query = placed.select("id", "x", "tree", "leaf", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    base = placed.select(F.col("id").alias("bid"), F.col("x").alias("bx"), F.col("tree").alias("btree"), F.col("leaf").alias("bleaf"), F.col("part").alias("bother"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("bpart"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"src": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        return nearest(a["id"].to_numpy(), _matrix(a["x"]), b["bid"].to_numpy(), _matrix(b["bx"]), k, similarity)

    found = query.groupBy("tree", "leaf", "part", "other").cogroup(base.groupBy("btree", "bleaf", "bpart", "bother")).applyInPandas(run, "src long, dst long, dist double").groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    return _ranked(found, k, similarity)


def knn(points: DataFrame, k: int, similarity: str = "euclidean", method: str = "exact") -> DataFrame:
    """Neighbours by the exact search, or by the forest (approximate) if that is named."""
    if similarity not in SIMILARITIES:
        raise ValueError(f"unknown similarity {similarity!r}; known: {', '.join(SIMILARITIES)}")
    if method not in ("exact", "forest"):
        raise ValueError("method is exact or forest")
    return (knn_exact if method == "exact" else knn_forest)(points, k, similarity)
