"""p-Laplace, absolutely minimising and p-eikonal equations on graphs.

A fixed number of rounds runs as joins.  Solving to a tolerance takes hundreds of cheap rounds: sweeps
on packed blocks (the explicit scheme for p: numpy, or joins beyond a checked size).  Boundary tables are (id, g), or wide: a column for each of several problems, which
then share every join (null where a node isn't on that problem's boundary).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import blocks, local
from weftgraph.operators.fixpoint import cut


def _boundary(boundary: DataFrame) -> DataFrame:
    return boundary.groupBy("id").agg(F.min("g").cast("double").alias("g"))


def boundary_frame(nodes: DataFrame, ids: DataFrame, g: DataFrame | float = 0.0) -> DataFrame:
    """Boundary (id, g) from ids and one number or (id, g)."""
    own = nodes.join(ids.select("id").distinct(), "id", "left_semi").select("id")
    return own.join(g.select("id", "g"), "id") if isinstance(g, DataFrame) else own.withColumn("g", F.lit(float(g)))


Value = Callable[[str], Column]


def moved(new: DataFrame, old: DataFrame, cols: list[str]) -> float:
    """The greatest change of any value."""
    both = new.join(old.toDF("id", *[f"old_{c}" for c in cols]), "id")
    return both.agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"old_{c}")) for c in cols], F.lit(0.0)))).first()[0] or 0.0


def _sweep(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, cols: list[str], start: Value, value: Value, rounds: int, tol: float | None, slopes: bool = False, every: int = 4) -> DataFrame:
    """u_i <- value of the sums over its edges, off the boundary, for all columns at once.

    ``value`` of a column uses s, lo, hi (of u_j, with the column's name after a _) and sw, and with
    ``slopes`` also u, ss, slo and shi (of w (u_j - u_i)), for which u is joined at both ends.
    """
    base = cut(nodes.select("id").join(boundary.select("id", *[F.col(c).cast("double").alias(f"g_{c}") for c in cols]), "id", "left"))
    u = cut(base.select("id", *[F.coalesce(f"g_{c}", start(c)).alias(c) for c in cols]))
    for k in range(rounds):
        both = edges.join(u.toDF("dst", *[f"j_{c}" for c in cols]), "dst")
        sums = [F.sum("w").alias("sw")]
        for c in cols:
            j = F.col(f"j_{c}")
            sums += [F.sum(F.col("w") * j).alias(f"s_{c}"), F.min(j).alias(f"lo_{c}"), F.max(j).alias(f"hi_{c}")]
            if slopes:
                slope = F.col("w") * (j - F.col(f"i_{c}"))
                sums += [F.sum(slope).alias(f"ss_{c}"), F.min(slope).alias(f"slo_{c}"), F.max(slope).alias(f"shi_{c}")]
        if slopes:
            both = both.join(u.toDF("src", *[f"i_{c}" for c in cols]), "src")
        known = base.join(both.groupBy(F.col("src").alias("id")).agg(*sums), "id", "left")
        if slopes:
            known = known.join(u, "id")
        # a node without edges keeps what it began with
        new = known.select("id", *[F.coalesce(f"g_{c}", F.when(F.col("sw").isNull(), start(c)).otherwise(value(c))).alias(c) for c in cols])
        if tol is not None or (k + 1) % every == 0 or k + 1 == rounds:
            new = cut(new)
        if tol is not None and moved(new, u, cols) <= tol:
            return new
        u = new
    return u


def _lists(edges: DataFrame, u: DataFrame, cols: list[str]) -> DataFrame:
    """id and for each column the neighbours' (u, w), sorted, where they have a value: arrays as long as a node's edges."""
    near = edges.join(u.withColumnRenamed("id", "dst"), "dst")
    return near.groupBy(F.col("src").alias("id")).agg(*[F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("u"), "w")))).alias(f"n_{c}") for c in cols])


def _bisected(lo: Column, hi: Column, above: Callable[[Column], Column], times: int) -> Column:
    """The root between lo and hi of what ``above`` says a value lies under."""

    def step(a: Column, _: Column) -> Column:
        t = (a["lo"] + a["hi"]) / 2
        return F.when(above(t), F.struct(t.alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), t.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), F.struct(lo.alias("lo"), hi.alias("hi")), step, lambda a: (a["lo"] + a["hi"]) / 2)


def _boundary_wide(boundary: DataFrame) -> DataFrame:
    return _boundary(boundary).withColumnRenamed("g", "u")


def _at(g: local.Local, boundary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    b = _boundary(boundary).toPandas()
    return g.index(b["id"].to_numpy()), b["g"].to_numpy(float)


def _local_sweeps(g: local.Local, at: np.ndarray, value: np.ndarray, step: Callable[[np.ndarray], np.ndarray], tol: float, max_iter: int) -> np.ndarray:
    u = np.full(g.n, value.min())
    u[at] = value
    bare = np.diff(g.starts) == 0
    for _ in range(max_iter):
        new = np.where(bare, u, step(u))
        new[at] = value
        done = np.abs(new - u).max(initial=0) <= tol
        u = new
        if done:
            break
    return u


def plaplace_local(g: local.Local, at: np.ndarray, value: np.ndarray, p: float, fast: bool = True, tol: float = 1e-6, max_iter: int = 100_000) -> np.ndarray:
    d = np.where(g.degree > 0, g.degree, 1)
    if fast:
        a = 1 / (p - 1)
        return _local_sweeps(g, at, value, lambda u: a * g.times(u) / d + (1 - a) * (g.reduce(u[g.col], np.minimum, 0) + g.reduce(u[g.col], np.maximum, 0)) / 2, tol, max_iter)
    dt = 0.9 / (1 / p + 2 * (1 - 2 / p)) / (g.w.max(initial=0) or 1.0)
    both = [np.full(g.n, value.max()), np.full(g.n, value.min())]
    for k in range(max_iter):
        for i, u in enumerate(both):
            u = u.copy()
            u[at] = value
            slope = g.w * (u[g.col] - u[g.row])
            new = u + dt * (np.bincount(g.row, slope, g.n) / (p * d) + (1 - 2 / p) * (np.minimum(g.reduce(slope, np.minimum, 0), 0) + np.maximum(g.reduce(slope, np.maximum, 0), 0)))
            new[at] = value
            both[i] = new
        if k > 10 and (both[0] - both[1]).max() < tol:
            break
    return (both[0] + both[1]) / 2


def plaplace_joins(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, cols: list[str], p: float, fast: bool = True, rounds: int | None = None, tol: float = 1e-6, max_iter: int = 100_000) -> DataFrame:
    """All columns' p-Laplace equations as joins; boundary (id and the columns)."""
    ends = boundary.agg(*[F.min(c) for c in cols], *[F.max(c) for c in cols]).first()
    least, most = (dict(zip(cols, map(float, x), strict=True)) for x in (ends[: len(cols)], ends[len(cols) :]))
    n = rounds if rounds is not None else max_iter
    if fast:
        a = 1 / (p - 1)
        value = lambda c: a * F.col(f"s_{c}") / F.col("sw") + (1 - a) * (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2
        return _sweep(nodes, edges, boundary, cols, lambda c: F.lit(least[c]), value, n, None if rounds is not None else tol)
    dt = 0.9 / (1 / p + 2 * (1 - 2 / p)) / (edges.agg(F.max("w")).first()[0] or 1.0)
    value = lambda c: F.col(c) + dt * (F.col(f"ss_{c}") / (p * F.col("sw")) + (1 - 2 / p) * (F.least(f"slo_{c}", F.lit(0.0)) + F.greatest(f"shi_{c}", F.lit(0.0))))
    sides = []
    for start in (most, least):
        sides.append(_sweep(nodes, edges, boundary, cols, lambda c: F.lit(start[c]), value, n, None if rounds is not None else tol * dt / 10, slopes=True))  # noqa: B023
    low = sides[1].toDF("id", *[f"low_{c}" for c in cols])
    return sides[0].join(low, "id").select("id", *[((F.col(c) + F.col(f"low_{c}")) / 2).alias(c) for c in cols])


def _ends(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(x, starts, axis=0), np.maximum.reduceat(x, starts, axis=0)


def _spread(t: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A row's values at each of its entries."""
    return np.repeat(t, np.diff(np.append(starts, n)), axis=0)


def _with_start(nodes: DataFrame, boundary: DataFrame, cols: list[str], start: Sequence[float], *more: DataFrame) -> DataFrame:
    """A row for each node: the columns at their start, the boundary's values h_c, and further columns (id and they)."""
    rows = nodes.select("id", *[F.lit(float(x)).alias(c) for c, x in zip(cols, start, strict=True)]).join(boundary.select("id", *[F.col(c).cast("double").alias(f"h_{c}") for c in cols]), "id", "left")
    for m in more:
        rows = rows.join(m, "id", "left")
    return rows


def plaplace_blocks(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, cols: list[str], p: float, tol: float = 1e-6, max_iter: int = 100_000, entries: int = blocks.ENTRIES) -> DataFrame:
    """All columns' equations u = a mean_w(u) + b (min + max) / 2 in sweeps on packed blocks; boundary (id and the columns)."""
    least = boundary.agg(*[F.min(c) for c in cols]).first()
    a = 1 / (p - 1)

    def value(w: np.ndarray, x: np.ndarray, starts: np.ndarray, u: np.ndarray, more: np.ndarray) -> np.ndarray:
        lo, hi = _ends(x, starts)
        return a * np.add.reduceat(w * x, starts, axis=0) / np.add.reduceat(w, starts, axis=0) + (1 - a) * (lo + hi) / 2

    return blocks.settle(nodes, edges, _with_start(nodes, boundary, cols, least), cols, value, tol, max_iter, entries=entries)


def _balanced(w: np.ndarray, x: np.ndarray, starts: np.ndarray, u: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The root t of min w (x - t) + max w (x - t) = 0, from u on.

    A step goes to the root of the two neighbours that pull most, or where that leaves what is known to
    hold the root, to its middle; rows that have settled are left out of the next.
    """
    (lo, hi), size = _ends(x, starts), np.diff(np.append(starts, len(x)))
    t = np.clip(u, lo, hi)
    out, live = t.copy(), np.arange(len(t))
    for _ in range(60):
        slope = w * (x - np.repeat(t, size, axis=0))
        down, up = _ends(slope, starts)
        most = lambda end: np.maximum.reduceat(np.where(slope == np.repeat(end, size, axis=0), w, 0.0), starts, axis=0)  # noqa: B023, E731
        weight, off = most(down) + most(up), down + up
        lo, hi = np.where(off > 0, t, lo), np.where(off < 0, t, hi)
        new = t + off / np.where(weight > 0, weight, 1)
        new = np.where(off == 0, t, np.where((new > lo) & (new < hi), new, (lo + hi) / 2))
        out[live] = new
        on = (np.abs(new - t) > 1e-12).any(1)
        if not on.any():
            break
        some, size = np.repeat(on, size), size[on]
        w, x, t, lo, hi, live = w[some], x[some], new[on], lo[on], hi[on], live[on]
        starts = np.cumsum(size) - size
    return out


def amle_blocks(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, cols: list[str], weighted: bool = False, tol: float = 1e-6, max_iter: int = 100_000, entries: int = blocks.ENTRIES) -> DataFrame:
    """All columns' extensions in sweeps on packed blocks; boundary (id and the columns)."""
    least = boundary.agg(*[F.min(c) for c in cols]).first()

    def middle(w: np.ndarray, x: np.ndarray, starts: np.ndarray, u: np.ndarray, more: np.ndarray) -> np.ndarray:
        lo, hi = _ends(x, starts)
        return (lo + hi) / 2

    return blocks.settle(nodes, edges, _with_start(nodes, boundary, cols, least), cols, _balanced if weighted else middle, tol, max_iter, entries=entries)


def plaplace(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, p: float, fast: bool = True, rounds: int | None = None, tol: float = 1e-6, max_iter: int = 100_000) -> DataFrame:
    """id, u: game-theoretic p-Laplace equation with u = g on the boundary (id, g).

    fast: u = a mean_w(u) + b (min + max) / 2 with a = 1 / (p - 1), b = 1 - a, on the neighbours'
    values.  Otherwise upper and lower solutions of the weighted operator, moved by explicit steps
    until they meet within tol (and more than 10 rounds), and their mean.
    """
    if rounds is None and fast:
        return plaplace_blocks(nodes, edges, _boundary_wide(boundary), ["u"], p, tol, max_iter)
    if rounds is not None or not local.fits(nodes, edges):
        return plaplace_joins(nodes, edges, _boundary_wide(boundary), ["u"], p, fast, rounds, tol, max_iter)
    g = local.gather(nodes, edges)
    return local.frame(nodes.sparkSession, g, plaplace_local(g, *_at(g, boundary), p, fast, tol, max_iter))


def amle_local(g: local.Local, at: np.ndarray, value: np.ndarray, weighted: bool = False, tol: float = 1e-6, max_iter: int = 100_000) -> np.ndarray:
    def step(u: np.ndarray) -> np.ndarray:
        lo, hi = g.reduce(u[g.col], np.minimum, 0), g.reduce(u[g.col], np.maximum, 0)
        for _ in range(30 if weighted else 0):
            t = (lo + hi) / 2
            slope = g.w * (u[g.col] - t[g.row])
            above = g.reduce(slope, np.minimum, 0) + g.reduce(slope, np.maximum, 0) > 0
            lo, hi = np.where(above, t, lo), np.where(above, hi, t)
        return (lo + hi) / 2

    return _local_sweeps(g, at, value, step, tol, max_iter)


def amle_joins(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, cols: list[str], weighted: bool = False, rounds: int | None = None, tol: float = 1e-6, max_iter: int = 100_000, every: int = 3) -> DataFrame:
    """All columns' extensions as joins; boundary (id and the columns)."""
    least = dict(zip(cols, map(float, boundary.agg(*[F.min(c) for c in cols]).first()), strict=True))
    n = rounds if rounds is not None else max_iter
    if not weighted:
        return _sweep(nodes, edges, boundary, cols, lambda c: F.lit(least[c]), lambda c: (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2, n, None if rounds is not None else tol)
    base = cut(nodes.select("id").join(boundary.select("id", *[F.col(c).cast("double").alias(f"g_{c}") for c in cols]), "id", "left"))
    u = cut(base.select("id", *[F.coalesce(f"g_{c}", F.lit(least[c])).alias(c) for c in cols]))

    def value(c: str) -> Column:
        near = F.col(f"n_{c}")
        slopes = lambda t: F.transform(near, lambda x: x["w"] * (x["u"] - t))
        return _bisected(near[0]["u"], F.element_at(near, -1)["u"], lambda t: F.array_min(slopes(t)) + F.array_max(slopes(t)) > 0, 30)

    for k in range(n):
        new = base.join(_lists(edges, u, cols), "id", "left").select("id", *[F.coalesce(f"g_{c}", F.when(F.size(f"n_{c}") > 0, value(c)), F.lit(least[c])).alias(c) for c in cols])
        if rounds is None or (k + 1) % every == 0 or k + 1 == n:
            new = cut(new)
        if rounds is None and moved(new, u, cols) <= tol:
            return new
        u = new
    return u


def amle(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, weighted: bool = False, rounds: int | None = None, tol: float = 1e-6, max_iter: int = 100_000) -> DataFrame:
    """Absolutely minimising Lipschitz extension: u = (min + max) / 2 of the neighbours, or with weights the root t of min w (u_j - t) + max w (u_j - t) = 0 (bisection)."""
    if rounds is not None:
        return amle_joins(nodes, edges, _boundary_wide(boundary), ["u"], weighted, rounds, tol, max_iter)
    return amle_blocks(nodes, edges, _boundary_wide(boundary), ["u"], weighted, tol, max_iter)


def dilate_boundary(nodes: DataFrame, edges: DataFrame, boundary: DataFrame) -> DataFrame:
    """Boundary (id, g) and its neighbours, each with the mean of the boundary values next to it."""
    near = edges.join(boundary.select(F.col("id").alias("dst"), "g"), "dst").join(boundary.select(F.col("id").alias("src")), "src", "left_anti").groupBy(F.col("src").alias("id")).agg(F.avg("g").alias("g"))
    return boundary.select("id", F.col("g").cast("double").alias("g")).unionByName(near)


def _eikonal_value(near: Column, f: Column, p: float) -> Column:
    """t with the sum of w (t - u)_+ ** p over the sorted neighbours (u, w) equal to f: over prefixes for p = 1, else by bisection."""
    if p == 1:
        start = F.struct(F.lit(float("inf")).alias("t"), f.alias("num"), F.lit(0.0).alias("den"))
        step = lambda a, x: F.when(x["u"] >= a["t"], a).otherwise(F.struct(((a["num"] + x["w"] * x["u"]) / (a["den"] + x["w"])).alias("t"), (a["num"] + x["w"] * x["u"]).alias("num"), (a["den"] + x["w"]).alias("den")))
        return F.aggregate(near, start, step)["t"]
    lo = near[0]["u"]
    under = lambda t: F.aggregate(near, F.lit(0.0), lambda s, x: s + x["w"] * F.pow(F.greatest(t - x["u"], F.lit(0.0)), F.lit(float(p)))) < f
    return _bisected(lo, lo + F.pow(f / near[0]["w"], F.lit(1.0 / p)), under, 60)


def peikonal_joins(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, cols: list[str], p: float = 1.0, f: DataFrame | float = 1.0, rounds: int | None = None, u0: DataFrame | None = None, tol: float = 1e-12, max_iter: int = 100_000, every: int = 3) -> DataFrame:
    """id and the columns: the p-eikonal equation for several boundaries (id and the columns, null off a column's boundary) as joins.

    From infinity off the boundary (or from u0, an upper solution): only nodes that a boundary has
    reached take part.
    """
    base = nodes.select("id").join(boundary.select("id", *[F.col(c).cast("double").alias(f"g_{c}") for c in cols]), "id", "left")
    base = cut(base.withColumn("f", F.lit(float(f))) if not isinstance(f, DataFrame) else base.join(f.select("id", "f"), "id"))
    any_of = lambda names: reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in names])
    first = base.select("id", *[F.col(f"g_{c}").alias(c) for c in cols])
    if u0 is not None:
        first = first.join(u0.select("id", F.when(F.col("u") < float("inf"), F.col("u")).alias("_u0")), "id", "left").select("id", *[F.coalesce(c, "_u0").alias(c) for c in cols])
    u = cut(first.where(any_of(cols)))
    for k in range(rounds if rounds is not None else max_iter):
        value = {c: F.when(F.size(f"n_{c}") > 0, _eikonal_value(F.col(f"n_{c}"), F.col("f"), p)) for c in cols}
        new = base.join(_lists(edges, u, cols), "id", "left").select("id", *[F.coalesce(f"g_{c}", value[c]).alias(c) for c in cols]).where(any_of(cols))
        if rounds is None or (k + 1) % every == 0 or k + 1 == rounds:
            new = cut(new)
        if rounds is None:
            both = new.join(u.toDF("id", *[f"old_{c}" for c in cols]), "id", "left")
            same = reduce(lambda x, y: x & y, [F.coalesce(F.abs(F.col(c) - F.col(f"old_{c}")) <= tol, F.col(c).isNull() & F.col(f"old_{c}").isNull()) for c in cols])
            if both.where(~same).isEmpty():
                u = new
                break
        u = new
    return nodes.select("id").join(u, "id", "left").select("id", *[F.coalesce(c, F.lit(float("inf"))).alias(c) for c in cols])


def _arrival(p: float) -> blocks.Value:
    """t with the sum of w (t - x)_+ ** p equal to f (the first further column) over the neighbours that are reached; infinite if none is."""

    def value(w: np.ndarray, x: np.ndarray, starts: np.ndarray, u: np.ndarray, more: np.ndarray) -> np.ndarray:
        lo, f, n = np.minimum.reduceat(x, starts, axis=0), more[:, :1], len(x)
        some = np.isfinite(lo)
        lo = np.where(some, lo, 0.0)
        first = np.maximum.reduceat(np.where(x <= _spread(lo, starts, n), w, 0.0), starts, axis=0)
        hi = lo + (f / np.where(some, np.maximum(first, 1e-300), 1.0)) ** (1 / p)
        if p < 1:
            for _ in range(60):
                t = (lo + hi) / 2
                up = np.add.reduceat(w * np.maximum(_spread(t, starts, n) - x, 0.0) ** p, starts, axis=0) < f
                lo, hi = np.where(up, t, lo), np.where(up, hi, t)
            return np.where(some, (lo + hi) / 2, np.inf)
        t = hi
        for _ in range(100):  # the sum is convex: Newton's steps from above fall to the root
            gap = np.maximum(_spread(t, starts, n) - x, 0.0)
            slope = w * (gap > 0) if p == 1 else w * gap ** (p - 1)
            rise = p * np.add.reduceat(slope, starts, axis=0)
            new = np.maximum(t - np.maximum(np.add.reduceat(slope * gap, starts, axis=0) - f, 0.0) / np.where(rise > 0, rise, 1.0), lo)
            still = some & (t - new > 1e-15 * np.abs(t))
            t = np.where(still, new, t)
            if not still.any():
                break
        return np.where(some, t, np.inf)

    return value


def peikonal_blocks(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, cols: list[str], p: float = 1.0, f: DataFrame | float = 1.0, u0: DataFrame | None = None, tol: float = 1e-10, max_iter: int = 100_000, entries: int = blocks.ENTRIES) -> DataFrame:
    """id and the columns: the p-eikonal equation for several boundaries (null off a column's) in sweeps on packed blocks, from infinity or from u0."""
    right = f.select("id", F.col("f").cast("double").alias("f")) if isinstance(f, DataFrame) else nodes.select("id", F.lit(float(f)).alias("f"))
    rows = _with_start(nodes, boundary, cols, [float("inf")] * len(cols), right)
    if u0 is not None:
        rows = rows.join(u0.select("id", F.col("u").alias("_u0")), "id", "left").withColumns({c: F.coalesce("_u0", c) for c in cols}).drop("_u0")
    # edges without weight reach nothing
    return blocks.settle(nodes, edges.where("w > 0"), rows, cols, _arrival(p), tol, max_iter, entries=entries)


def peikonal_p1(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, f: DataFrame | float = 1.0, rounds: int | None = None) -> DataFrame:
    """The equation for p = 1 as joins: sum of w (u_i - u_j)_+ = f, solved exactly over each node's sorted neighbours.

    With neighbours in the order of u: the least prefix m whose t = (f + sum w u) / sum w doesn't
    exceed the next value.
    """
    return peikonal_joins(nodes, edges, _boundary_wide(boundary), ["u"], 1.0, f, rounds)


def peikonal_local(g: local.Local, at: np.ndarray, value: np.ndarray, p: float, rhs: np.ndarray, u0: np.ndarray | None = None, tol: float = 1e-10, max_iter: int = 100_000) -> np.ndarray:
    u = np.full(g.n, np.inf) if u0 is None else u0.copy()
    u[at] = value
    for _ in range(max_iter):
        uj = u[g.col]
        finite = np.isfinite(uj)
        w = np.where(finite, g.w, 0)
        some = np.bincount(g.row, w, g.n) > 0
        lo = g.reduce(np.where(finite, uj, np.inf), np.minimum, np.inf)
        lo = np.where(some, lo, 0)
        hi = lo + (rhs / np.where(some, np.maximum(g.reduce(np.where(finite & (np.where(finite, uj, np.inf) <= lo[g.row]), g.w, 0), np.maximum, 0), 1e-300), 1)) ** (1 / p)
        for _ in range(60):
            t = (lo + hi) / 2
            total = np.bincount(g.row, w * np.maximum(t[g.row] - np.where(finite, uj, 0), 0) ** p, g.n)
            up = total < rhs
            lo, hi = np.where(up, t, lo), np.where(up, hi, t)
        new = np.where(some, (lo + hi) / 2, np.inf)
        new[at] = value
        gap = np.where(np.isfinite(new) & np.isfinite(u), np.abs(new - np.where(np.isfinite(u), u, 0)), np.where(np.isfinite(new) == np.isfinite(u), 0, np.inf))
        u = new
        if gap.max(initial=0) <= tol:
            break
    return u


def peikonal(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, p: float = 1.0, f: DataFrame | float = 1.0, nl_bdy: bool = False, u0: DataFrame | None = None, tol: float = 1e-10, max_iter: int = 100_000) -> DataFrame:
    """id, u: sum over j of w_ij (u_i - u_j)_+ ** p = f off the boundary; unreached nodes are infinite.

    Sweeps over all nodes on packed blocks, from infinity (or from u0, an upper solution); each node is
    solved from its finite neighbours.
    """
    if nl_bdy:
        boundary = dilate_boundary(nodes, edges, boundary)
    return peikonal_blocks(nodes, edges, _boundary_wide(boundary), ["u"], p, f, u0, tol, max_iter)
