"""Boundary statistic of a point cloud, and triangulations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vectors
from weftgraph.operators.calculus import degrees
from weftgraph.operators.fixpoint import cut
from weftgraph.operators.knn import knn
from weftgraph.operators.weights import epsilon_ball


def boundary_statistic(points: DataFrame, k: int = 10, radius: float | None = None, second_order: bool = True, cutoff: bool = True) -> DataFrame:
    """id, t: how far a point's neighbours lie inwards of it along the estimated normal; small near the boundary.

    Normals are -L x, with L the Laplacian of W D^-1 (second order) or W; t is the greatest
    <x_i - x_j, (n_i + n_j) / 2> over the neighbours, with n_i alone if <n_i, n_j> <= 0 and cutoff is
    on.  Neighbours are k (the point itself included) or those within a radius.
    """
    if radius is None:
        near = knn(points, k - 1, method="exact")
        edges = near.select("src", "dst", F.lit(1.0).alias("w"))
    else:
        edges = epsilon_ball(points, radius, "uniform")
    nodes = points.select("id")
    d = degrees(nodes, edges)
    if second_order:
        edges = edges.join(d.where("d > 0").select(F.col("id").alias("dst"), "d"), "dst").select("src", "dst", (F.col("w") / F.col("d")).alias("w"))
    a, b = points.select(F.col("id").alias("src"), F.col("x").alias("xi")), points.select(F.col("id").alias("dst"), F.col("x").alias("xj"))
    pairs = edges.join(a, "src").join(b, "dst")
    dims = F.transform("xi", lambda x, i: F.struct(i.alias("i"), (F.col("w") * (F.get("xj", i) - x)).alias("v")))
    summed = pairs.select("src", F.inline(dims)).groupBy("src", "i").agg(F.sum("v").alias("v")).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("nu"))
    normals = summed.select(F.col("src").alias("id"), vectors.unit(F.col("nu")).alias("nu"))
    both = pairs.join(normals.select(F.col("id").alias("src"), F.col("nu").alias("ni")), "src").join(normals.select(F.col("id").alias("dst"), F.col("nu").alias("nj")), "dst")
    middle = F.zip_with("ni", "nj", lambda x, y: (x + y) / 2)
    way = F.when(vectors.dot(F.col("ni"), F.col("nj")) <= 0, F.col("ni")).otherwise(middle) if cutoff else middle
    off = vectors.dot(F.zip_with("xi", "xj", lambda x, y: x - y), way)
    found = both.groupBy(F.col("src").alias("id")).agg(F.max(off).alias("t"))
    return nodes.join(found, "id", "left").select("id", F.greatest(F.coalesce("t", F.lit(0.0)), F.lit(0.0)).alias("t"))


#: Points of a cell of a triangulation, about, and most cells (their corners are the driver's).
CELL, MOST_CELLS = 1000, 1 << 14
#: Points inside a circle that a cell tells of at once.
DEEPEST = 8


def _cross(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Twice the area of o, a, b: positive where they turn left."""
    u, v = a - o, b - o
    return u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]


def _depth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the origin lies inside the circles of a, b, c (counterclockwise), times twice their area, and what rounding may make of 0."""
    minors = [u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0] for u, v in ((b, c), (c, a), (a, b))]
    sizes = [np.abs(u[:, 0] * v[:, 1]) + np.abs(u[:, 1] * v[:, 0]) for u, v in ((b, c), (c, a), (a, b))]
    squares = [(u * u).sum(1) for u in (a, b, c)]
    return sum(x * m for x, m in zip(squares, minors, strict=True)), 1e-15 * sum(x * m for x, m in zip(squares, sizes, strict=True))


def _hull(p: np.ndarray, order: np.ndarray) -> list[tuple[int, int]]:
    """The hull's sides, counterclockwise, points on a side included; ``order`` by x, then y."""
    out: list[int] = []
    for some in (order.tolist(), order[::-1].tolist()):
        chain: list[int] = []
        for i in some:
            while len(chain) > 1 and _cross(p[chain[-2]], p[chain[-1]], p[i]) < 0:
                chain.pop()
            chain.append(i)
        out += chain[:-1]
    return [(a, b) for a, b in zip(out, out[1:] + out[:1], strict=True) if a != b]


def _wrapped(p: np.ndarray, tri: np.ndarray, hull: list[tuple[int, int]], own: np.ndarray) -> np.ndarray:
    """The triangles and those that lack at sides of own points, each with the point that sees the side at the widest angle."""
    rim = set(hull)
    have = {side for a, b, c in tri.tolist() for side in ((a, b), (b, c), (c, a))}
    front = [s for s in hull if s not in have] + [(b, a) for a, b in have if (b, a) not in have and (a, b) not in rim]
    more, tiny = [], 1e-14 * float(np.ptp(p, 0).max(initial=0)) ** 2
    while front:
        a, b = front.pop()
        if (a, b) in have or not (own[a] or own[b]):
            continue
        area = _cross(p[a], p[b], p)
        cot = np.where(area > tiny, ((p[a] - p) * (p[b] - p)).sum(1) / np.where(area > tiny, area, 1), np.inf)
        c = int(cot.argmin())
        if cot[c] == np.inf:
            continue
        more.append((a, b, c))
        have |= {(a, b), (b, c), (c, a)}
        front += [(y, x) for x, y in ((b, c), (c, a)) if (y, x) not in have and (x, y) not in rim]
    return np.concatenate([tri, np.array(more, int).reshape(-1, 3)])


def delaunay(xy: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Triangles (rows of three indices, counterclockwise) of different points in the plane, by Bowyer and Watson's insertion, to the hull.

    Points are inserted by x, then y, and a point on a circle counts as inside, so that points of one
    circle are always joined to the last of them.  A triangle whose circle lies left of the next point is done.
    With ``own`` only triangles at those points need be there.
    """
    n = len(xy)
    if n < 3:
        return np.zeros((0, 3), int)
    xy = xy - (xy.min(0) + xy.max(0)) / 2
    low, span = xy.min(0), float(max(np.ptp(xy, 0).max(), 1e-12))
    far = np.array([low + [-30 * span, -10 * span], low + [30 * span, -10 * span], low + [0.5 * span, 40 * span]])
    p = np.concatenate([xy, far])

    def circle(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
        ab, ac = b - a, c - a
        det = 2 * (ab[:, 0] * ac[:, 1] - ab[:, 1] * ac[:, 0])
        det = np.where(det == 0, 1e-300, det)
        sb, sc = (ab * ab).sum(1), (ac * ac).sum(1)
        off = np.stack([ac[:, 1] * sb - ab[:, 1] * sc, ab[:, 0] * sc - ac[:, 0] * sb], 1) / det[:, None]
        return a + off, (off * off).sum(1)

    tri, done = np.array([[n, n + 1, n + 2]]), []
    centre, r2 = circle(tri)
    order = np.lexsort((xy[:, 1], xy[:, 0]))
    for k, i in enumerate(order):
        if k % 16 == 0:
            past = centre[:, 0] + np.sqrt(r2) * (1 + 1e-9) < p[i, 0]
            done.append(tri[past])
            tri, centre, r2 = tri[~past], centre[~past], r2[~past]
        room = ((centre - p[i]) ** 2).sum(1) - r2
        bad = room < 0
        close = np.flatnonzero(np.abs(room) <= 1e-5 * r2)  # told by the determinant, which doesn't cancel
        if len(close):
            depth, noise = _depth(*(p[tri[close, j]] - p[i] for j in range(3)))
            bad[close] = depth * np.sign(_cross(*(p[tri[close, j]] for j in range(3)))) >= -noise
        sides = np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]])
        keys, count = np.unique(np.sort(sides, 1) @ np.array([n + 3, 1]), return_counts=True)
        rim = np.stack(np.divmod(keys[count == 1], n + 3), 1)
        new = np.column_stack([rim, np.full(len(rim), i)])
        c, r = circle(new)
        tri, centre, r2 = np.concatenate([tri[~bad], new]), np.concatenate([centre[~bad], c]), np.concatenate([r2[~bad], r])
    tri = np.concatenate([*done, tri])
    tri = tri[(tri < n).all(1)]
    area = _cross(xy[tri[:, 0]], xy[tri[:, 1]], xy[tri[:, 2]])
    tri = np.where((area < 0)[:, None], tri[:, [0, 2, 1]], tri)[area != 0]
    return _wrapped(xy, tri, _hull(xy, order), np.ones(n, bool) if own is None else own)


def _inside(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Numbers of the points that lie in a triangle's circle (six coordinates) or right of a side (four): the deepest few, and all on it."""
    if len(q) == 4:
        a, b = q.reshape(2, 2)
        depth = -_cross(a, b, p)
        noise = 1e-13 * np.abs(b - a).max() * np.abs(p - a).max(1)
        on = (np.abs(depth) <= noise) & (((p - a) * (p - b)).sum(1) < 0)
    else:
        depth, noise = _depth(*(v - p for v in q.reshape(3, 1, 2)))
        on = np.abs(depth) <= noise
    within = np.flatnonzero(depth > noise)
    return np.concatenate([within[np.argsort(-depth[within])[:DEEPEST]], np.flatnonzero(on)])


def _met(q: np.ndarray, rects: np.ndarray) -> np.ndarray:
    """Which rectangles (least x, y, greatest x, y) a circle or the right of a side may touch."""
    a, b = q[:2], q[2:4]
    if len(q) == 4:
        corners = np.stack([rects[:, [i, j]] for i in (0, 2) for j in (1, 3)], 1)
        return (_cross(a, b, corners) <= 1e-9 * np.abs(b - a).max() * np.abs(corners - a).max((1, 2))[:, None]).any(1)
    area = 2 * _cross(a, b, q[4:])
    ab, ac = b - a, q[4:] - a
    if abs(area) <= 1e-9 * max((ab * ab).sum(), (ac * ac).sum()):
        return np.ones(len(rects), bool)
    off = np.array([ac[1] * (ab @ ab) - ab[1] * (ac @ ac), ab[0] * (ac @ ac) - ac[0] * (ab @ ab)]) / area
    centre, r = a + off, np.sqrt(off @ off)
    gap = np.maximum(np.maximum(rects[:, :2] - centre, centre - rects[:, 2:]), 0)
    return np.sqrt((gap * gap).sum(1)) <= r * (1 + 1e-6)


def _celled(points: DataFrame, cell: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """cell, id, x, y in strips of x and their parts of y of about so many points; the cells' numbers and rectangles."""
    n = points.count()
    side = int(np.ceil(np.sqrt(min(max(n / cell, 1), MOST_CELLS))))
    if side > 1:
        cuts = [i / side for i in range(1, side)]
        xs = np.unique(points.approxQuantile("x", cuts, 0.1 / side))
        strip = F.lit(0)
        for v in xs.tolist():
            strip = strip + F.when(F.col("x") > v, 1).otherwise(0)
        points = points.withColumn("strip", strip)
        ys = points.groupBy("strip").agg(F.percentile_approx("y", cuts, 20 * side).alias("cuts"))
        points = points.join(F.broadcast(ys), "strip").select((F.col("strip") * side + F.size(F.filter("cuts", lambda c: c < F.col("y")))).cast("long").alias("cell"), "id", "x", "y")
    else:
        points = points.select(F.lit(0).cast("long").alias("cell"), "id", "x", "y")
    points = cut(points)
    found = points.groupBy("cell").agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).orderBy("cell").collect()
    return points, np.array([r[0] for r in found], np.int64), np.array([r[1:] for r in found], float).reshape(-1, 4)


def mesh(points: DataFrame, pad: float = 0.0, cell: int = CELL) -> DataFrame:
    """a, b, c: ids (ascending) of the triangles of planar points (id, x); of points at one place the least id stands for all.

    The plane is cut into cells of about so many points.  A cell triangulates its own points and those
    near it, and asks the cells that the circles of its points' triangles (and the outside of its hull) touch for
    points inside; with these it does so again, until there are none.  So each triangle's circle is
    empty of all points, and no task sees more than a cell, its surroundings, and what was asked for.

    With ``pad``, points of a frame that far outside are added first and their triangles left out, so
    that triangles on the hull are as regular as inside.
    """
    spark = points.sparkSession
    xy = points.select(F.col("id").cast("long").alias("id"), F.col("x")[0].cast("double").alias("x"), F.col("x")[1].cast("double").alias("y"))
    places = xy.groupBy((F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).agg(F.min("id").alias("id")).select("id", "x", "y")
    last = None
    if pad:
        count, last, *ends = xy.agg(F.count("*"), F.max("id"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        low, high = np.array(ends[:2]) - pad, np.array(ends[2:]) + pad
        s = np.linspace(0, 1, max(4, int(np.sqrt(count))))
        frame = np.concatenate([np.stack([low[0] + s * (high[0] - low[0]), np.full(len(s), y)], 1) for y in (low[1], high[1])] + [np.stack([np.full(len(s) - 2, x), low[1] + s[1:-1] * (high[1] - low[1])], 1) for x in (low[0], high[0])])
        places = places.unionByName(spark.createDataFrame(pd.DataFrame({"id": last + 1 + np.arange(len(frame)), "x": frame[:, 0], "y": frame[:, 1]})))
    own, cells, rects = _celled(places, cell)
    if not len(cells):
        return spark.createDataFrame([], "a long, b long, c long")
    # a cell knows all points within a fifth of its size
    edge = 0.2 * np.tile(rects[:, 2:] - rects[:, :2], 2) * [-1, -1, 1, 1]
    wide = rects + edge if len(cells) > 1 else np.array([[-np.inf, -np.inf, np.inf, np.inf]])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_numpy(), b.column(3).to_numpy()
            hit, at = np.nonzero((wide[:, :1] <= x) & (x <= wide[:, 2:3]) & (wide[:, 1:2] <= y) & (y <= wide[:, 3:]))
            other = cells[hit] != b.column(0).to_numpy()[at]
            yield pa.RecordBatch.from_arrays([pa.array(cells[hit[other]]), *[b.column(j).take(pa.array(at[other])) for j in (1, 2, 3)]], ["cell", "id", "x", "y"])

    def around(key: tuple, mine: pa.Table, others: pa.Table) -> pa.Table:
        number = key[0].as_py()
        box = wide[np.searchsorted(cells, number)]
        ids = np.concatenate([mine.column("id").to_numpy(), others.column("id").to_numpy()])
        at = np.concatenate([np.stack([t.column(c).to_numpy() for c in ("x", "y")], 1) for t in (mine, others)])
        first = np.arange(len(ids)) < mine.num_rows
        t = delaunay(at, first)
        t = t[first[t].any(1)]
        keep = np.sort(ids[t], 1)
        keep = keep[np.isin(keep[:, 0], ids[first])]
        a, b, c = at[t[:, 0]], at[t[:, 1]], at[t[:, 2]]
        area = 2 * _cross(a, b, c)
        sb, sc = ((b - a) ** 2).sum(1), ((c - a) ** 2).sum(1)
        off = np.stack([(c - a)[:, 1] * sb - (b - a)[:, 1] * sc, (b - a)[:, 0] * sc - (c - a)[:, 0] * sb], 1) / area[:, None]
        middle, r = a + off, np.sqrt((off * off).sum(1)) * (1 + 1e-6)
        open_ = (middle - r[:, None] < box[:2]).any(1) | (middle + r[:, None] > box[2:]).any(1)
        asks = [*np.concatenate([a, b, c], 1)[open_].tolist()]
        if np.isfinite(box).all():
            asks += [[*at[i], *at[j]] for i, j in _hull(at, np.lexsort((at[:, 1], at[:, 0]))) if first[i] or first[j]]
        n, m = len(keep), len(asks)
        none = pa.nulls(m, pa.int64())
        cols = {name: pa.concat_arrays([pa.array(np.ascontiguousarray(keep[:, j])), none]) for j, name in enumerate("abc")}
        return pa.table({"cell": pa.array(np.full(n + m, number))} | cols | {"q": pa.array([None] * n + asks, pa.list_(pa.float64()))})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(int(t), who, q) for who, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in cells[_met(np.array(q), rects)]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["at", "cell", "q"])

    def answered(mine: pa.Table, asked: pa.Table) -> pa.Table:
        p = np.stack([mine.column(c).to_numpy() for c in ("x", "y")], 1)
        found = [_inside(np.array(q), p) for q in asked.column("q").to_pylist()] if mine.num_rows else []
        who = np.repeat(asked.column("cell").to_numpy()[: len(found)], [len(f) for f in found])
        pairs = np.unique(np.stack([who, np.concatenate([*found, np.zeros(0, int)]).astype(int)], 1), axis=0)
        return pa.table({"cell": pa.array(pairs[:, 0])} | {c: mine.column(c).take(pa.array(pairs[:, 1])) for c in ("id", "x", "y")})

    known, active, out = cut(own.mapInArrow(near, "cell long, id long, x double, y double")), own, []
    while True:
        made = cut(active.groupBy("cell").cogroup(known.groupBy("cell")).applyInArrow(around, "cell long, a long, b long, c long, q array<double>"))
        if len(cells) == 1:
            out.append(made)
            break
        asked = made.where("q is not null").select("cell", "q").mapInArrow(sent, "at long, cell long, q array<double>")
        found = own.groupBy("cell").cogroup(asked.groupBy("at")).applyInArrow(answered, "cell long, id long, x double, y double").distinct()
        new = cut(found.join(own.unionByName(known).select("cell", "id"), ["cell", "id"], "left_anti"))
        again = cut(new.select("cell").distinct())
        out.append(made.join(again, "cell", "left_anti"))
        if again.isEmpty():
            break
        active = own.join(again, "cell", "left_semi")
        known = cut(known.join(again, "cell", "left_semi").unionByName(new))
    rows = reduce(DataFrame.unionByName, out).where("q is null").select("a", "b", "c")
    return cut(rows if last is None else rows.where(F.col("c") <= last))
