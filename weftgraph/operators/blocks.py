"""Sparse symmetric matrices as packed row blocks, and eigenpairs by steps that move only vectors.

A matrix is cut once into blocks of consecutive rows of some ``ENTRIES`` entries.  A block is one row
of a table: its ids, its entries as packed arrays whose columns are numbered by the block's own rows
and then by the rows of other blocks that it needs (its halo), and for each block that needs some of its
rows which ones.  The table is partitioned by block and written to the shared folder; it is never
shuffled again.  Vectors (a few columns side by side) are rows too: each block's own part, and a
message for each pair of blocks with the part that the one needs of the other.  A step brings a block
and what was sent to it together, and its result is sent on in the same task: one shuffle of vector
parts for each product, and no row for each entry or node.

A row of the matrix isn't split; a node with very many entries is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import local
from weftgraph.operators.fixpoint import cut, forget, release

#: Entries of the matrix (and rows, which count as one each) in a block: some 50 MB.  What a step sends grows with
#: the number of blocks, for nearly all of them need a row that has neighbours all over the graph.
ENTRIES = 1 << 22
#: Entries of a row that a product takes place by place; of longer rows the rest is summed row by row.
PLACES = 64
STATIC = "p long, ids binary, starts binary, cols binary, w binary, halo binary, to binary, to_starts binary, rows binary"
STATE = "p long, q long, data binary"


@dataclass
class Block:
    p: int
    ids: np.ndarray
    starts: np.ndarray  # of each row's entries
    cols: np.ndarray  # numbers of own rows, then of halo rows
    w: np.ndarray
    halo: np.ndarray  # pairs: block, how many of its rows are needed; in the order of the columns
    to: np.ndarray  # blocks that need rows of this one
    to_starts: np.ndarray
    rows: np.ndarray  # the rows they need
    rho: float = 0.0  # of a term rho d d^T, d being what each row's other entries sum to, negated
    dots: np.ndarray | float = 0.0  # what other blocks have of d . x

    @property
    def degree(self) -> np.ndarray:
        row = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        return -np.bincount(row, np.where(self.cols == row, 0.0, self.w), len(self.ids))

    @classmethod
    def of(cls, row: dict) -> Block:
        get = lambda name, kind: np.frombuffer(row[name], kind)
        return cls(row["p"], get("ids", np.int64), get("starts", np.int64), get("cols", np.int32), get("w", np.float64), get("halo", np.int64).reshape(-1, 2), get("to", np.int64), get("to_starts", np.int64), get("rows", np.int32))

    def some(self, width: int) -> Iterator[tuple[np.ndarray, slice, np.ndarray]]:
        """Rows that have entries, some at a time: their numbers, their entries, and where each one's begin among these."""
        rows = np.flatnonzero(np.diff(self.starts))
        step, at = max(1, (1 << 21) // max(1, width)), 0
        while at < len(rows):
            first = self.starts[rows[at]]
            end = max(at + 1, int(np.searchsorted(self.starts[rows + 1], first + step, "right")))
            yield rows[at:end], slice(first, self.starts[rows[end - 1] + 1]), self.starts[rows[at:end]] - first
            at = end

    @cached_property
    def places(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], Block]:
        """Rows by falling number of entries; for each place in a row the columns and weights of the first rows, which have one there; and what lies beyond ``PLACES``."""
        count = np.diff(self.starts)
        order = np.argsort(-count, kind="stable")
        first, sizes = self.starts[:-1][order], -count[order]
        at = [first[: np.searchsorted(sizes, -j, "left")] + j for j in range(min(PLACES, int(count.max(initial=0))))]
        left = np.maximum(count - PLACES, 0)
        starts = np.concatenate([[0], np.cumsum(left)])
        rest = np.repeat(self.starts[:-1] + PLACES - starts[:-1], left) + np.arange(starts[-1])
        none = np.zeros(0, np.int64)
        return order, [(self.cols[a], self.w[a]) for a in at], Block(self.p, self.ids, starts, self.cols[rest], self.w[rest], none.reshape(-1, 2), none, none, none)

    def times(self, own: np.ndarray, halo: np.ndarray) -> np.ndarray:
        """The block's rows of the matrix times the vectors' columns; rows are taken some at a time, and of those their first entries, their second ones, and so on."""
        x = np.concatenate([own, halo]) if len(halo) else own
        out = np.zeros((len(self.ids), x.shape[1]))
        order, places, rest = self.places
        step = max(1, (1 << 17) // max(1, x.shape[1]))
        for at in range(0, len(order), step):
            total = np.zeros((len(order[at : at + step]), x.shape[1]))
            for cols, w in places:
                if len(cols) <= at:
                    break
                part = x.take(cols[at : at + step], 0)
                part *= w[at : at + step, None]
                total[: len(part)] += part
            out[order[at : at + step]] = total
        for rows, part, starts in rest.some(x.shape[1]):
            out[rows] += np.add.reduceat(rest.w[part, None] * x[rest.cols[part]], starts, axis=0)
        if self.rho:
            d = self.degree
            out += self.rho * d[:, None] * (d @ own + self.dots)[None]
        return out


Step = Callable[[Block, np.ndarray, np.ndarray], np.ndarray]


def _read(block: Block, table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's own part, and what was sent to it in the order of its columns."""
    own, sent = np.zeros((len(block.ids), 0)), {}
    for q, data in zip(table.column("q").to_pylist(), table.column("data").to_pylist(), strict=True):
        x = np.frombuffer(data, np.float64)
        if q == block.p:
            own = x.reshape(len(block.ids), -1)
        elif q < 0:
            block.dots = block.dots + x
        else:
            sent[q] = x.reshape(-1, width)
    parts = [sent[q] for q in block.halo[:, 0].tolist()] if sent else []
    return own, np.concatenate(parts) if parts else np.zeros((0, width))


Shared = Callable[[Block, np.ndarray], np.ndarray]


def _write(block: Block, own: np.ndarray, width: int, everyone: list[int] | None = None, shared: Shared | None = None) -> pa.Table:
    """The own part, and messages of its last ``width`` columns; with a term of rank one its part of d . x for every other block, or its part of ``shared``."""
    out = np.ascontiguousarray(own[:, own.shape[1] - width :])
    p, q, data = [block.p], [block.p], [np.ascontiguousarray(own).tobytes()]
    if width:
        for k, to in enumerate(block.to.tolist()):
            p.append(to)
            q.append(block.p)
            data.append(out[block.rows[block.to_starts[k] : block.to_starts[k + 1]]].tobytes())
        if block.rho or shared:
            part = np.asarray(shared(block, out) if shared else block.degree @ out, np.float64).tobytes()
            for to in everyone or []:
                if to != block.p:
                    p.append(to)
                    q.append(-1 - block.p)
                    data.append(part)
    return pa.table({"p": pa.array(p, pa.int64()), "q": pa.array(q, pa.int64()), "data": pa.array(data, pa.binary())})


def _write_own(p: int, x: np.ndarray) -> pa.Table:
    return pa.table({"p": pa.array([p], pa.int64()), "q": pa.array([p], pa.int64()), "data": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())})


def _ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.frombuffer(data, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), p))], ["id", "p"])


def _stepper(steps: list[Step], send: int, width: int, rho: float = 0.0, everyone: list[int] | None = None, shared: Shared | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block.of(left.to_pylist()[0])
        block.rho = rho
        own, halo = _read(block, right, width)
        for s in steps:
            own = s(block, own, halo)
        return _write(block, own, send, everyone, shared)

    return run


class Blocks:
    """A matrix (src, dst, w) on nodes (id) in blocks; rows and columns of nodes that aren't there are left out."""

    def __init__(self, nodes: DataFrame, a: DataFrame, entries: int = ENTRIES, rho: float = 0.0):
        self.spark, self.rho = nodes.sparkSession, rho
        placed = _placed(nodes, a, entries)
        # an edge knows the blocks of both its ends
        e = a.join(placed.select(F.col("id").alias("src"), F.col("p").alias("p")), "src").join(placed.select(F.col("id").alias("dst"), F.col("p").alias("q")), "dst").select("p", "src", "q", "dst", F.col("w").cast("double").alias("w"))
        packed = cut(placed.groupBy("p").cogroup(e.groupBy("p")).applyInArrow(_pack, "p long, ids binary, starts binary, cols binary, w binary, halo binary, asked array<struct<q:long,ids:binary>>"))
        asked = packed.select(F.col("p").alias("who"), F.inline("asked")).select(F.col("q").alias("p"), "who", "ids")
        self.table = cut(packed.drop("asked").groupBy("p").cogroup(asked.groupBy("p")).applyInArrow(_with_sends, STATIC))
        self.everyone = sorted(r.p for r in self.table.select("p").collect())  # a number for each block
        self.count = len(self.everyone)
        release(self.spark)

    def start(self, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """Own parts of vectors whose rows are a function of the ids."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield from _write_own(p, np.asarray(make(np.frombuffer(ids, np.int64)), np.float64)).to_batches()

        return self.table.select("p", "ids").mapInArrow(run, STATE)

    def steps(self, state: DataFrame, steps: list[Step], width: int, shared: Shared | None = None) -> DataFrame:
        """Own parts after so many steps; between them the last ``width`` columns are sent to the blocks that need them.

        A step gets the block, its own part and what was sent (nothing in the first).  A matrix of one
        block needs no messages, so that all of its steps are one.  ``shared``: numbers of what a block sends,
        whose sum over all other blocks each gets as ``dots``.
        """
        single = self.count <= 1
        for k, some in enumerate([steps] if single else [[s] for s in steps]):
            state = self.table.groupBy("p").cogroup(state.groupBy("p")).applyInArrow(_stepper(some, 0 if single or k + 1 == len(steps) else width, width, self.rho, self.everyone if self.rho or shared else None, shared), STATE)
        return state

    def place(self, values: DataFrame, cols: list[str]) -> DataFrame:
        """Own parts of columns given by node (id and the columns); zero where a node has none."""
        width = len(cols)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:  # ids that aren't of the matrix
                return _write_own(-1, np.zeros((0, width))).slice(0, 0)
            ids, x = np.frombuffer(left.column("ids")[0].as_py(), np.int64), None
            x = np.zeros((len(ids), width))
            at = np.searchsorted(ids, right.column("id").to_numpy())
            for j, c in enumerate(cols):
                x[at, j] = right.column(c).fill_null(0.0).to_numpy()
            return _write_own(left.column("p")[0].as_py(), x)

        where = self.table.select("p", "ids").mapInArrow(_ids_of, "id long, p long")
        known = values.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in cols]).join(where, "id")
        return self.table.select("p", "ids").groupBy("p").cogroup(known.groupBy("p")).applyInArrow(run, STATE)

    def gram(self, state: DataFrame, width: int) -> np.ndarray:
        """Products of all pairs of columns of own parts: width squared sums, partly summed in each task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, width))
            for b in batches:
                for data in b.column(2):
                    x = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, width)
                    total += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["k", "v"])

        out = np.zeros(width * width)
        for r in state.where("p = q").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            out[r.k] = r.v
        return out.reshape(width, width)

    def greatest(self, state: DataFrame, width: int) -> float:
        """The greatest value of own parts' first column."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(2):
                    x = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, width)
                    yield pa.RecordBatch.from_arrays([pa.array([float(x[:, 0].max(initial=-np.inf))])], ["v"])

        return float(state.where("p = q").mapInArrow(run, "v double").agg(F.max("v")).first()[0])

    def frame(self, state: DataFrame, m: np.ndarray | slice, names: list[str]) -> DataFrame:
        """id and the columns (own part times m, or some of them) as a table of nodes."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            block = Block.of(left.to_pylist()[0])
            x = _read(block, right, 0)[0]
            x = x[:, m] if isinstance(m, slice) else x @ m
            return pa.table({"id": pa.array(block.ids)} | {c: pa.array(np.ascontiguousarray(x[:, j])) for j, c in enumerate(names)})

        return self.table.groupBy("p").cogroup(state.where("p = q").groupBy("p")).applyInArrow(run, ", ".join(["id long", *[f"{c} double" for c in names]]))


def _placed(nodes: DataFrame, a: DataFrame, entries: int) -> DataFrame:
    """id, p: blocks of consecutive ids by running sums of rows and entries, within range partitions and from partition to partition."""
    n = a.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    sized = nodes.select(F.col("id").cast("long").alias("id")).distinct().join(n, "id", "left").select("id", (1 + F.coalesce("n", F.lit(0))).alias("n"))
    dealt = cut(sized.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("s"))  # a row for each partition
    before = sums.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s0"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("id")) - F.col("n")
    return cut(dealt.withColumn("k", inside).join(F.broadcast(before), "part").select("id", F.floor((F.col("k") + F.col("s0")) / entries).cast("long").alias("p")))


def _pack(nodes: pa.Table, e: pa.Table) -> pa.Table:
    """One block: its ids, entries by row, and the ids that it needs of other blocks."""
    ids = np.sort(nodes.column("id").to_numpy())
    p = nodes.column("p")[0].as_py() if nodes.num_rows else e.column("p")[0].as_py()
    src, dst, q, w = (e.column(c).to_numpy() for c in ("src", "dst", "q", "w"))
    order = np.lexsort((dst, src))
    src, dst, q, w = src[order], dst[order], q[order], w[order]
    row = np.searchsorted(ids, src)
    starts = np.searchsorted(row, np.arange(len(ids) + 1))
    cols = np.zeros(len(dst), np.int64)
    cols[q == p] = np.searchsorted(ids, dst[q == p])
    asked, halo, at = [], [], len(ids)
    for other in np.unique(q[q != p]).tolist():
        own = np.unique(dst[q == other])
        cols[q == other] = at + np.searchsorted(own, dst[q == other])
        at += len(own)
        halo.append((other, len(own)))
        asked.append({"q": other, "ids": own.astype(np.int64).tobytes()})
    kind = pa.list_(pa.struct([("q", pa.int64()), ("ids", pa.binary())]))
    made = [ids.astype(np.int64), starts.astype(np.int64), cols.astype(np.int32), w.astype(np.float64), np.array(halo, np.int64)]
    return pa.table({"p": pa.array([p], pa.int64())} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("ids", "starts", "cols", "w", "halo"), made, strict=True)} | {"asked": pa.array([asked], kind)})


def _with_sends(block: pa.Table, asked: pa.Table) -> pa.Table:
    """A block with the rows that others have asked it for."""
    ids = np.frombuffer(block.column("ids")[0].as_py(), np.int64)
    rows = sorted(zip(asked.column("who").to_pylist(), asked.column("ids").to_pylist(), strict=True))
    found = [np.searchsorted(ids, np.frombuffer(x, np.int64)).astype(np.int32) for _, x in rows]
    sends = {"to": np.array([who for who, _ in rows], np.int64), "to_starts": np.cumsum([0, *map(len, found)]).astype(np.int64), "rows": np.concatenate(found) if found else np.zeros(0, np.int32)}
    return pa.table({c: block.column(c) for c in ("p", "ids", "starts", "cols", "w", "halo")} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in sends.items()})


def bounds(a: DataFrame) -> tuple[float, float]:
    """Bounds of a symmetric matrix's spectrum by Gershgorin's circles."""
    off = F.sum(F.when(F.col("src") != F.col("dst"), F.abs("w")).otherwise(0.0))
    own = F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0))
    got = a.groupBy("src").agg(own.alias("own"), off.alias("off")).agg(F.min(F.col("own") - F.col("off")), F.max(F.col("own") + F.col("off"))).first()
    return float(got[0] or 0.0), float(got[1] or 0.0)


def started(ids: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Numbers in [-1/2, 1/2) that are functions of the id, the column and the seed."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))[None]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) - 0.5


def _ritz(g: np.ndarray, k: int, tiny: float = 1e-13) -> tuple[np.ndarray, np.ndarray, float]:
    """From the products of [X, A X]: Ritz values ascending, their vectors in terms of X, and the greatest residual of the first k."""
    c = len(g) // 2
    scale = 1 / np.sqrt(np.maximum(np.diag(g)[:c], 1e-300))
    own, mid, image = (m * scale[:, None] * scale[None] for m in (g[:c, :c], (g[:c, c:] + g[c:, :c]) / 2, g[c:, c:]))
    vals, vecs = np.linalg.eigh(own)
    good = vals > tiny * vals.max()
    base = vecs[:, good] / np.sqrt(vals[good])
    h = base.T @ mid @ base
    ritz, y = np.linalg.eigh((h + h.T) / 2)
    y = base @ y
    off = np.einsum("ij,ik,kj->j", y, image, y) - 2 * ritz * np.einsum("ij,ik,kj->j", y, mid, y) + ritz**2 * np.einsum("ij,ik,kj->j", y, own, y)
    return ritz, y * scale[:, None], float(np.sqrt(np.maximum(off[:k], 0)).max(initial=0))


def _roots(low: float, high: float, degree: int) -> np.ndarray:
    """The roots of the Chebyshev polynomial on an interval, in Leja's order: products of their factors neither overflow nor cancel on the way."""
    left = np.cos(np.pi * (2 * np.arange(degree) + 1) / (2 * degree)).tolist()
    out = [left.pop(0)]
    while left:
        out.append(left.pop(int(np.argmax([np.log(np.abs(x - np.array(out))).sum() for x in left]))))
    return (low + high) / 2 + (high - low) / 2 * np.array(out)


def smallest(nodes: DataFrame, a: DataFrame, k: int, tol: float = 1e-6, low: float | None = None, top: float | None = None, degree: int = 24, max_sweeps: int = 80, seed: int = 0, entries: int = ENTRIES, rho: float = 0.0) -> tuple[np.ndarray, DataFrame, float]:
    """Smallest k eigenvalues of a symmetric matrix (ascending), their vectors (id, v0, v1, ...), and the greatest residual.

    Subspace iteration on 2 k + 4 columns.  A sweep applies a Chebyshev polynomial that damps what lies
    above the block's greatest value, factor by factor, so that a step moves these columns and no
    others; then the values and residuals
    of the block come from products of its columns with themselves and their images.  It ends at a
    residual of tol * (top - low), or with an error.  rho adds a term of rank one, rho d d^T with d what
    the other entries of each row sum to, negated (the degrees, if the matrix is a Laplacian without
    loops); then the bounds must be given.
    """
    if low is None or top is None:
        low, top = bounds(a)
    m = Blocks(nodes, a, entries, rho)
    width = 2 * k + 4
    if m.count == 0:
        return np.zeros(0), nodes.select(F.col("id").cast("long").alias("id"), *[F.lit(0.0).alias(f"v{j}") for j in range(k)]).limit(0), 0.0
    image: Step = lambda b, own, halo: np.concatenate([own, b.times(own, halo)], 1)
    stay: Step = lambda b, own, halo: own
    state = cut(m.steps(m.start(lambda ids: started(ids, width, seed)), [stay, image], width))
    vals, mix, off = _ritz(m.gram(state, 2 * width), k)
    span = max(top - low, 1e-300)
    for _ in range(max_sweeps):
        if off <= tol * span or len(vals) < width:
            break
        # from half of the block on: what is beyond k needn't be kept
        edge = float(vals[-1])
        if (top - edge) / 2 <= 1e-12 * span:  # the block holds the whole spectrum
            break
        at, c = min(float(vals[0]), low), len(vals)
        roots = _roots(edge, top, degree)

        def begin(b: Block, own: np.ndarray, halo: np.ndarray, mix=mix, root=roots[0], at=at, width=width) -> np.ndarray:
            return (own[:, width:] @ mix - root * (own[:, :width] @ mix)) / (at - root)

        steps = [begin]
        for root in roots[1:]:
            steps.append(lambda b, own, halo, root=root, at=at: (b.times(own, halo) - root * own) / (at - root))
        old, state = state, cut(m.steps(state, [*steps, image], c))
        forget(old)
        width = c
        vals, mix, off = _ritz(m.gram(state, 2 * width), k)
        release(m.spark)
    else:
        raise RuntimeError(f"eigenvectors didn't settle: residual {off}")
    k = min(k, len(vals))
    both = np.concatenate([mix[:, :k], np.zeros((width, k))])
    return vals[:k], cut(m.frame(state, both, [f"v{j}" for j in range(k)])), off


def lowrank(nodes: DataFrame, a: DataFrame, top: float, k: int, sweeps: int, every: int = 5, seed: int = 0, entries: int = ENTRIES) -> tuple[np.ndarray, DataFrame]:
    """So many sweeps of randomised subspace iteration with top - A; the columns are made orthonormal after every few."""
    m, width = Blocks(nodes, a, entries), 2 * k
    image: Step = lambda b, own, halo: np.concatenate([own, b.times(own, halo)], 1)
    stay: Step = lambda b, own, halo: own
    state = cut(m.steps(m.start(lambda ids: started(ids, width, seed)), [stay, image], width))
    done = 0
    while True:
        vals, mix, _ = _ritz(m.gram(state, 2 * width), k)
        if done >= sweeps:
            k = min(k, len(vals))
            return vals[:k], cut(m.frame(state, np.concatenate([mix[:, :k], np.zeros((width, k))]), [f"v{j}" for j in range(k)]))
        c = len(vals)

        def begin(b: Block, own: np.ndarray, halo: np.ndarray, mix=mix, width=width) -> np.ndarray:
            return top * (own[:, :width] @ mix) - own[:, width:] @ mix

        go: Step = lambda b, own, halo: top * own - b.times(own, halo)
        n = min(every, sweeps - done)
        state, done, width = cut(m.steps(state, [begin, *[go] * (n - 1), image], c)), done + n, c


def exponential(nodes: DataFrame, q: DataFrame, t: float, start: Callable[[np.ndarray], np.ndarray], width: int, entries: int = ENTRIES) -> tuple[Blocks, DataFrame]:
    """exp(Q t) times the columns that ``start`` gives for ids: the blocks, and the own parts of the result.

    Q may be of any kind.  The time is cut so that a step's norm (by the greatest row sum) is at most
    1, and each step is a Taylor polynomial of degree 18 (an error below 1e-16), two columns of vectors
    for each: the sum so far and the last term.
    """
    m = Blocks(nodes, q, entries)
    norm = float(q.groupBy("src").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s")).first()[0] or 0.0) * abs(t)
    cuts = max(1, int(np.ceil(norm)))
    state = m.start(start)
    begin: Step = lambda b, own, halo: np.concatenate([own[:, :width], own[:, :width]], 1)

    def term(j: int) -> Step:
        def go(b: Block, own: np.ndarray, halo: np.ndarray) -> np.ndarray:
            new = b.times(own[:, width:], halo) * (t / cuts / j)
            return np.concatenate([own[:, :width] + new, new], 1)

        return go

    for _ in range(cuts):
        old, state = state, cut(m.steps(state, [begin, *[term(j) for j in range(1, 19)]], width))
        forget(old)
    return m, state


def residuals(nodes: DataFrame, a: DataFrame, vals: np.ndarray, u: DataFrame) -> DataFrame:
    """id and for each vector what A v - value * v leaves at the node (r0, r1, ...): a join of the matrix and the vectors."""
    cols = u.columns[1:]
    images = a.join(u.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"a_{c}") for c in cols])
    return u.join(images, "id", "left").select("id", *[(F.coalesce(f"a_{c}", F.lit(0.0)) - F.lit(float(v)) * F.col(c)).alias(f"r{j}") for j, (c, v) in enumerate(zip(cols, vals, strict=True))])


Value = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def swept(block: Block, own: np.ndarray, halo: np.ndarray, value: Value, c: int, aux: int) -> np.ndarray:
    """One sweep over a state (greatest change, whether held, further columns, u): rows that aren't held and have entries get ``value``.

    The value is a function of the entries' weights (a column), the neighbours' u, where each row's entries
    begin, the row's own u, and its further columns.
    """
    u, held, more = own[:, -c:], own[:, 1 : 1 + c] > 0, own[:, 1 + c : 1 + c + aux]
    x, new = np.concatenate([u, halo]) if len(halo) else u, u.copy()
    for rows, part, starts in block.some(c):
        new[rows] = value(block.w[part, None], x[block.cols[part]], starts, u[rows], more[rows])
    new[held] = u[held]
    with np.errstate(invalid="ignore"):
        gap = np.where(new == u, 0.0, np.abs(new - u))
    return np.concatenate([gap.max(1, initial=0)[:, None], own[:, 1 : 1 + c + aux], new], 1)


def settle(nodes: DataFrame, edges: DataFrame, start: DataFrame, cols: list[str], value: Value, tol: float, max_iter: int, every: int = 8, entries: int = ENTRIES) -> DataFrame:
    """id and the columns: sweeps of all columns at once until no value moves by more than tol.

    ``start``: for every node id, the columns, for each the boundary's value h_c (null off it), and any
    further columns that the value needs.  In several blocks ``every`` sweeps are a job, of which the last
    one's changes are looked at.
    """
    c = len(cols)
    aux = [x for x in start.columns if x != "id" and x not in cols and x not in {f"h_{n}" for n in cols}]
    rows = start.select("id", *[F.col(f"h_{n}").isNotNull().cast("double").alias(f"k{j}") for j, n in enumerate(cols)], F.lit(0.0).alias("gap"), *[F.col(x).cast("double").alias(x) for x in aux], *[F.coalesce(f"h_{n}", n).cast("double").alias(f"x{j}") for j, n in enumerate(cols)])
    m = Blocks(nodes, edges, entries)
    state = cut(m.place(rows, ["gap", *[f"k{j}" for j in range(c)], *aux, *[f"x{j}" for j in range(c)]]))
    width = 1 + 2 * c + len(aux)
    move: Step = lambda block, own, halo: swept(block, own, halo, value, c, len(aux))
    pick = slice(width - c, width)

    if m.count <= 1:
        # columns don't need each other: a task for each
        n_aux = len(aux)

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    block, j = Block.of(row), row["j"]
                    own = np.frombuffer(row["data"], np.float64).reshape(-1, width)[:, [0, 1 + j, *range(1 + c, 1 + c + n_aux), 1 + c + n_aux + j]]
                    none = np.zeros((0, 1))
                    for _ in range(max_iter):
                        own = swept(block, own, none, value, 1, n_aux)
                        if own[:, 0].max(initial=0) <= tol:
                            break
                    yield pa.RecordBatch.from_arrays([pa.array([row["p"]]), pa.array([j]), pa.array([own[:, -1].tobytes()], pa.binary())], ["p", "j", "data"])

        def beside(left: pa.Table, right: pa.Table) -> pa.Table:
            found = dict(zip(right.column("j").to_pylist(), right.column("data").to_pylist(), strict=True))
            ids = np.frombuffer(left.column("ids")[0].as_py(), np.int64)
            return pa.table({"id": pa.array(ids)} | {f"x{j}": pa.array(np.frombuffer(found[j], np.float64)) for j in range(c)})

        each = m.table.join(state.select("p", "data"), "p").crossJoin(F.broadcast(m.spark.range(c).withColumnRenamed("id", "j"))).repartition(c, "j")
        parts = cut(each.mapInArrow(solve, "p long, j long, data binary"))
        return cut(m.table.select("p", "ids").groupBy("p").cogroup(parts.groupBy("p")).applyInArrow(beside, ", ".join(["id long", *[f"x{j} double" for j in range(c)]]))).toDF("id", *cols)
    stay: Step = lambda block, own, halo: own
    for done in range(0, max_iter, every):
        old, state = state, cut(m.steps(state, [stay, *[move] * min(every, max_iter - done)], c))
        forget(old)
        if m.greatest(state, width) <= tol:
            break
        release(m.spark)
    return cut(m.frame(state, pick, [f"x{j}" for j in range(c)])).toDF("id", *cols)


def conjgrad(nodes: DataFrame, a: DataFrame, b: DataFrame, cols: list[str], tol: float = 1e-10, max_iter: int = 10_000, power: int = 1, held: DataFrame | None = None, entries: int = ENTRIES) -> DataFrame:
    """id and the columns of the x that solves A**power x = b where x and the equations are left out on ``held`` (id); A symmetric, positive on the columns' span.

    Conjugate gradients for all columns, to a root of the sum of squared residuals of tol.  In a round
    vectors move once for each product, and the products of columns that set the next step are one
    aggregate.  A matrix of one block is solved where it lies.
    """
    m, c = Blocks(nodes, a, entries), len(cols)
    values = b.select("id", *[F.col(x).alias(f"b{j}") for j, x in enumerate(cols)])
    if held is not None:
        values = values.join(held.select("id").distinct(), "id", "left_anti").unionByName(held.select("id", F.lit(1.0).alias("held")).distinct(), allowMissingColumns=True)
    else:
        values = values.withColumn("held", F.lit(0.0))
    start = cut(m.place(values, ["held", *[f"b{j}" for j in range(c)]]))
    names = [f"x{j}" for j in range(c)]
    take = lambda at, width: np.eye(width)[:, at : at + c]

    def product(block: Block, free: np.ndarray, p: np.ndarray) -> np.ndarray:
        for _ in range(power):
            p = block.times(p, np.zeros((0, c)))
        return p * free

    if m.count <= 1:

        def solve(block: Block, own: np.ndarray, halo: np.ndarray) -> np.ndarray:
            free = 1 - own[:, :1]
            return local.conjgrad(lambda u: product(block, free, u), own[:, 1:] * free, tol=tol, max_iter=max_iter)

        return cut(m.frame(m.steps(start, [solve], 0), np.eye(c), names)).toDF("id", *cols)
    # columns of a state: held, x, r, p, and A p
    first: Step = lambda block, own, halo: np.concatenate([own[:, :1], 0 * own[:, 1:], own[:, 1:] * (1 - own[:, :1]), own[:, 1:] * (1 - own[:, :1])], 1)
    # between products the last columns are sent: p, and then what comes of it
    begin: Step = lambda block, own, halo: np.concatenate([own, block.times(own[:, -c:], halo)], 1)
    again: Step = lambda block, own, halo: np.concatenate([own[:, :-c], block.times(own[:, -c:], halo)], 1)
    close: Step = lambda block, own, halo: np.concatenate([own[:, :-c], own[:, -c:] * (1 - own[:, :1])], 1)
    width, move, state = 1 + 4 * c, first, start
    for _ in range(max_iter):
        # the products, and with the last of them the rows that are left out
        chain = [move, begin, *[again] * (power - 1)]
        last = chain.pop()
        chain.append(lambda block, own, halo, last=last: close(block, last(block, own, halo), halo))
        old, state = state, cut(m.steps(state, chain, c))
        forget(old)
        g = m.gram(state, width)
        at = lambda i, j: np.array([g[1 + i * c + k, 1 + j * c + k] for k in range(c)])
        rs, pap, rap, aa = at(1, 1), at(2, 3), at(1, 3), at(3, 3)
        alpha = np.where(pap != 0, rs / np.where(pap != 0, pap, 1), 0)
        new = np.maximum(rs - 2 * alpha * rap + alpha**2 * aa, 0)
        beta = np.where(rs != 0, new / np.where(rs != 0, rs, 1), 0)
        if np.sqrt(rs.sum()) <= tol:
            break

        def move(block: Block, own: np.ndarray, halo: np.ndarray, alpha=alpha, beta=beta) -> np.ndarray:
            x, r, p, ap = (own[:, 1 + k * c : 1 + (k + 1) * c] for k in range(4))
            r = r - alpha * ap
            return np.concatenate([own[:, :1], x + alpha * p, r, r + beta * p], 1)

    return cut(m.frame(state, take(1, width), names)).toDF("id", *cols)


def gmres(nodes: DataFrame, a: DataFrame, b: DataFrame, tol: float = 1e-10, restart: int = 40, max_restarts: int = 40, entries: int = ENTRIES) -> tuple[DataFrame, list[float]]:
    """id, u of A u = b (b: id, u), A of any kind; and the residual at each restart.

    The Arnoldi basis is the columns of the vectors' parts; all projections of a step are one aggregate,
    made twice so that the basis stays orthogonal, and the small least-squares problem is the driver's.
    A matrix of one block is solved where it lies.
    """
    m = Blocks(nodes, a, entries)
    start = cut(m.place(b.select("id", "u"), ["u"]))
    if m.count <= 1:
        one = lambda block, own, halo: local.gmres(lambda u: block.times(u[:, None], np.zeros((0, 1)))[:, 0], own[:, 0], tol)[:, None]
        return cut(m.frame(m.steps(start, [one], 0), np.eye(1), ["u"])), []
    # columns: b, x, and the basis; a vector that is sent is the last column
    stay: Step = lambda block, own, halo: own
    state, off = cut(m.steps(start, [lambda block, own, halo: np.concatenate([own, 0 * own, own], 1)], 0)), []
    for _ in range(max_restarts):
        beta = float(np.sqrt(m.gram(state, 3)[2, 2]))
        off.append(beta)
        if beta <= tol:
            break
        scale: Step = lambda block, own, halo, beta=beta: np.concatenate([own[:, :2], own[:, 2:] / beta], 1)
        state, h, width = cut(m.steps(state, [scale], 0)), np.zeros((restart + 1, restart)), 3
        for k in range(restart):
            image: Step = lambda block, own, halo: np.concatenate([own, block.times(own[:, -1:], halo)], 1)
            old, state = state, cut(m.steps(state, [stay, image], 1))
            forget(old)
            for _ in range(2):
                g = m.gram(state, width + 1)[2:width, width]
                h[: k + 1, k] += g
                less: Step = lambda block, own, halo, g=g: np.concatenate([own[:, :-1], own[:, -1:] - own[:, 2:-1] @ g[:, None]], 1)
                old, state = state, cut(m.steps(state, [less], 0))
                forget(old)
            width += 1
            h[k + 1, k] = np.sqrt(m.gram(state, width)[-1, -1])
            e = np.zeros(k + 2)
            e[0] = beta
            y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], e, rcond=None)
            if h[k + 1, k] < 1e-14 or np.linalg.norm(e - h[: k + 2, : k + 1] @ y) <= tol:
                break
            unit: Step = lambda block, own, halo, by=h[k + 1, k]: np.concatenate([own[:, :-1], own[:, -1:] / by], 1)
            state = cut(m.steps(state, [unit], 0))
        # x moves, and b - A x begins the next basis
        to: Step = lambda block, own, halo, y=y: np.concatenate([own[:, :1], own[:, 1:2] + own[:, 2 : 2 + len(y)] @ y[:, None]], 1)
        left: Step = lambda block, own, halo: np.concatenate([own, own[:, :1] - block.times(own[:, 1:], halo)], 1)
        state = cut(m.steps(state, [to, left], 1))
    else:
        raise RuntimeError(f"GMRES didn't settle: residual {off[-1]}")
    return cut(m.frame(state, np.array([[0.0], [1.0], [0.0]]), ["u"])), off
