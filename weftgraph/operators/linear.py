"""Matrix-vector products as joins, and what is built from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import blocks, local
from weftgraph.operators.calculus import degrees, laplacian
from weftgraph.operators.fixpoint import cut


def spmv(nodes: DataFrame, a: DataFrame, u: DataFrame, cols: list[str]) -> DataFrame:
    """id and the columns of A u: one join and one grouped sum for all columns, partly summed in each task."""
    sums = a.join(u.select(F.col("id").alias("dst"), *cols), "dst").groupBy(F.col("src").alias("id")).agg(*[F.expr(f"sum(w * {c}) AS {c}") for c in cols])
    return nodes.select("id").join(sums, "id", "left").selectExpr("id", *[f"coalesce({c}, 0D) AS {c}" for c in cols])


def conjgrad(nodes: DataFrame, a: DataFrame, b: DataFrame, cols: list[str], tol: float = 1e-10, max_iter: int = 10_000, plan: str = "auto") -> DataFrame:
    """Solve A x = b for all columns at once; A (src, dst, w) symmetric positive on the columns' span.

    On packed blocks unless a plan is named.  distributed: a round is one join for A p, with an
    aggregate for its products, and one new state with an aggregate for its residuals; all columns
    share them.  local: numpy, for a graph of checked size.
    """
    if plan == "auto":
        return blocks.conjgrad(nodes, a, b, cols, tol, max_iter)
    if plan == "local":
        g = local.gather(nodes, a)
        rows = b.select("id", *cols).toPandas().set_index("id").reindex(g.ids).fillna(0.0)[cols].to_numpy()
        x = local.conjgrad(g.times, rows, tol=tol, max_iter=max_iter)
        return local.frame(nodes.sparkSession, g, x, "_x").toDF("id", *cols)
    state = nodes.select("id").join(b.select("id", *cols), "id", "left").select("id", *[F.lit(0.0).alias(f"x_{c}") for c in cols], *[F.coalesce(c, F.lit(0.0)).alias(f"r_{c}") for c in cols], *[F.coalesce(c, F.lit(0.0)).alias(f"p_{c}") for c in cols])
    state = cut(state)
    norms = lambda s: np.array(s.agg(*[F.sum(F.col(f"r_{c}") ** 2) for c in cols]).first(), float)
    rs = norms(state)
    for _ in range(max_iter):
        if np.sqrt(rs.sum()) <= tol:
            break
        ap = spmv(nodes, a, state.select("id", *[F.col(f"p_{c}").alias(f"ap_{c}") for c in cols]), [f"ap_{c}" for c in cols])
        both = state.join(ap, "id")
        pap = np.array(both.agg(*[F.sum(F.col(f"p_{c}") * F.col(f"ap_{c}")) for c in cols]).first(), float)
        alpha = np.where(pap != 0, rs / np.where(pap != 0, pap, 1), 0)
        moved = cut(both.select("id", *[(F.col(f"x_{c}") + F.lit(float(al)) * F.col(f"p_{c}")).alias(f"x_{c}") for c, al in zip(cols, alpha, strict=True)], *[(F.col(f"r_{c}") - F.lit(float(al)) * F.col(f"ap_{c}")).alias(f"r_{c}") for c, al in zip(cols, alpha, strict=True)], *[f"p_{c}" for c in cols]))
        new = norms(moved)
        beta = np.where(rs != 0, new / np.where(rs != 0, rs, 1), 0)
        state = moved.select("id", *[f"x_{c}" for c in cols], *[f"r_{c}" for c in cols], *[(F.col(f"r_{c}") + F.lit(float(be)) * F.col(f"p_{c}")).alias(f"p_{c}") for c, be in zip(cols, beta, strict=True)])
        rs = new
    return state.select("id", *[F.col(f"x_{c}").alias(c) for c in cols])


def constrained_solve(nodes: DataFrame, a: DataFrame, f: DataFrame | None, boundary: DataFrame, cols: list[str], tol: float = 1e-10, plan: str = "auto") -> DataFrame:
    """A x = f off the boundary and x = g on it (boundary: id and the columns), by Jacobi-scaled conjugate gradients."""
    inner = nodes.select("id").join(boundary.select("id"), "id", "left_anti")
    free = a.join(inner.select(F.col("id").alias("src")), "src", "left_semi")
    own = free.join(inner.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "w")
    known = free.join(boundary.select(F.col("id").alias("dst"), *cols), "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"k_{c}") for c in cols])
    scale = cut(own.where("src = dst").select(F.col("src").alias("id"), (1 / F.sqrt("w")).alias("s")))
    b = inner.join(known, "id", "left").join(scale, "id")
    if f is not None:
        b = b.join(f.select("id", *cols), "id", "left")
    b = b.select("id", *[((F.coalesce(c, F.lit(0.0)) if f is not None else F.lit(0.0)) - F.coalesce(f"k_{c}", F.lit(0.0))).alias(c) for c in cols], "s").select("id", *[(F.col("s") * F.col(c)).alias(c) for c in cols])
    scaled = own.join(scale.select(F.col("id").alias("src"), F.col("s").alias("s1")), "src").join(scale.select(F.col("id").alias("dst"), F.col("s").alias("s2")), "dst").select("src", "dst", (F.col("s1") * F.col("w") * F.col("s2")).alias("w"))
    x = conjgrad(scale.select("id"), cut(scaled), b, cols, tol, plan=plan).join(scale, "id").select("id", *[(F.col("s") * F.col(c)).alias(c) for c in cols])
    return x.unionByName(boundary.select("id", *cols))


def constrained_solve_gmres(nodes: DataFrame, a: DataFrame, f: DataFrame | None, r: DataFrame, boundary: DataFrame, tol: float = 1e-10, entries: int = blocks.ENTRIES) -> DataFrame:
    """A x = f off the boundary and R x = g on it (boundary: id, g): the rows of R replace those of A; GMRES on packed blocks."""
    on = boundary.select(F.col("id").alias("src")).distinct()
    rows = cut(a.join(on, "src", "left_anti").select("src", "dst", "w").unionByName(r.join(on, "src", "left_semi").select("src", "dst", "w")))
    b = boundary.select("id", F.col("g").cast("double").alias("u"))
    if f is not None:
        b = f.select("id", F.col("u").cast("double").alias("u")).join(on.withColumnRenamed("src", "id"), "id", "left_anti").unionByName(b)
    return blocks.gmres(nodes, rows, b, tol, entries=entries)[0]


def page_rank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, teleport: DataFrame | None = None, tol: float = 1e-10, rounds: int | None = None, every: int = 5) -> DataFrame:
    """u <- alpha W^T D^-1 u + (1 - alpha) v until no value changes by more than tol, or for a number of rounds.

    v (id, v) is uniform unless given; the mass of nodes without edges is lost.
    """
    n = nodes.count()
    base = nodes.select("id").join(teleport, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v")) if teleport is not None else nodes.select("id", F.lit(1.0 / n).alias("v"))
    base = cut(base)
    walk = cut(edges.join(degrees(nodes, edges).where("d > 0").select(F.col("id").alias("src"), "d"), "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") / F.col("d")).alias("w")))
    u = base.select("id", F.col("v").alias("u"))
    for k in range(rounds if rounds is not None else 1000):
        sums = walk.join(u.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("u")).alias("s"))
        new = base.join(sums, "id", "left").select("id", (alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * F.col("v")).alias("u"))
        if rounds is None or (k + 1) % every == 0 or k + 1 == rounds:
            new = cut(new)
        if rounds is None and (new.join(u.withColumnRenamed("u", "old"), "id").agg(F.max(F.abs(F.col("u") - F.col("old")))).first()[0] or 0) <= tol:
            return new
        u = new
    return u


def number(x: float) -> str:
    """A double in SQL, in brackets."""
    return f"({float(x)!r}D)"


def _gram(u: DataFrame, cols: list[str]) -> np.ndarray:
    got = u.selectExpr(*[f"sum({a} * {b})" for i, a in enumerate(cols) for b in cols[i:]]).first()
    out, at = np.zeros((len(cols), len(cols))), 0
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            out[i, j] = out[j, i] = got[at] or 0.0
            at += 1
    return out


def _mixture(cols: list[str], m: np.ndarray, names: list[str]) -> list[str]:
    return [" + ".join(f"{number(m[i, j])} * {c}" for i, c in enumerate(cols)) + f" AS {names[j]}" for j in range(m.shape[1])]


def _mixed(u: DataFrame, cols: list[str], m: np.ndarray, names: list[str]) -> DataFrame:
    return u.selectExpr("id", *_mixture(cols, m, names))


Operator = Callable[[DataFrame, list[str]], DataFrame]


def _started(nodes: DataFrame, cols: list[str], seed: int) -> DataFrame:
    """Columns of numbers in [-1/2, 1/2) that are functions of the id and the seed."""
    return nodes.selectExpr("id", *[f"pmod(xxhash64(id, {seed}, {j}), {1 << 52}) / {float(1 << 52)!r}D - 0.5D AS {c}" for j, c in enumerate(cols)])


def _orthonormal(u: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """The span of the columns, orthonormalised by the eigenvectors of their Gram matrix; dependent columns go."""
    for _ in range(2):  # the second time mends what rounding leaves
        vals, vecs = np.linalg.eigh(_gram(u, cols))
        good = vals > 1e-13 * max(vals.max(), 1e-300)
        new = [f"v{j}" for j in range(int(good.sum()))]
        u = cut(_mixed(u, cols, vecs[:, good] / np.sqrt(vals[good]), new))
        cols = new
    return u, cols


def laplacian_operator(nodes: DataFrame, edges: DataFrame, kind: str = "normalized", gamma: float = 0.0) -> tuple[Operator, float]:
    """u -> L u (+ gamma d (d . u) / sum of d) on columns, as joins, and a bound of its spectrum; randomwalk stands for normalized."""
    kind = "combinatorial" if kind == "combinatorial" else "normalized"
    a = cut(laplacian(nodes, edges, kind))
    d = cut(degrees(nodes, edges))
    most, total, squares = d.agg(F.max("d"), F.sum("d"), F.sum(F.col("d") * F.col("d"))).first()
    top = 2 * most if kind == "combinatorial" else 2.0

    def apply(u: DataFrame, cols: list[str]) -> DataFrame:
        out = spmv(nodes, a, u, cols)
        if gamma:
            dots = u.join(d, "id").selectExpr(*[f"sum(d * {c})" for c in cols]).first()
            out = out.join(d, "id").selectExpr("id", *[f"{c} + {number(gamma / total * x)} * d AS {c}" for c, x in zip(cols, dots, strict=True)])
        return out

    return apply, top + (gamma * squares / total if gamma else 0.0)


def _ritz(u: DataFrame, cols: list[str], apply: Operator, k: int) -> tuple[np.ndarray, DataFrame, list[str], float]:
    """Rayleigh-Ritz on orthonormal columns: values ascending, vectors, and the greatest residual of the first k."""
    u, cols = _orthonormal(u, cols)
    images = [f"a_{c}" for c in cols]
    both = cut(u.join(apply(u, cols).toDF("id", *images), "id"))
    got = both.selectExpr(*[f"sum({x} * {y})" for x in cols for y in images]).first()
    m = np.array(got, float).reshape(len(cols), len(cols))
    vals, vecs = np.linalg.eigh((m + m.T) / 2)
    mixed = cut(both.selectExpr("id", *_mixture(cols, vecs, cols), *_mixture(images, vecs, images)))
    off = mixed.selectExpr(*[f"sqrt(sum(power(a_{c} - {number(v)} * {c}, 2)))" for c, v in zip(cols[:k], vals[:k], strict=False)]).first()
    return vals, mixed.select("id", *cols), cols, max(off)


def smallest_distributed(nodes: DataFrame, apply: Operator, top: float, k: int, tol: float = 1e-6, max_sweeps: int = 60, degree: int = 12, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """Smallest k eigenpairs of a symmetric operator with spectrum in [0, top], as joins, to a residual of tol * top.

    Subspace iteration on 2 k columns, each sweep a Chebyshev polynomial that damps what lies above
    the block's greatest value; an error if the residuals don't get there.
    """
    cols = [f"v{j}" for j in range(2 * k)]
    vals, u, cols, off = _ritz(cut(_started(nodes, cols, seed)), cols, apply, k)
    for _ in range(max_sweeps):
        if off <= tol * top or len(cols) < k:
            break
        half, middle = (top - vals[-1]) / 2, (top + vals[-1]) / 2
        if half <= 1e-12 * top:  # the block holds the whole spectrum
            break
        s = first = half / (min(vals[0], 0.0) - middle)
        old, new = cols, [f"y_{c}" for c in cols]
        image = apply(u, cols).toDF("id", *new)
        state = u.join(image, "id").selectExpr("id", *old, *[f"({y} - {number(middle)} * {c}) * {number(s / half)} AS {y}" for c, y in zip(old, new, strict=True)])
        for i in range(1, degree):
            if i % 3 == 0:
                state = cut(state)
            nxt = 1 / (2 / first - s)
            image = apply(state.select("id", *new), new).toDF("id", *[f"z_{c}" for c in cols])
            state = state.join(image, "id").selectExpr("id", *[f"{y} AS {c}" for c, y in zip(old, new, strict=True)], *[f"(z_{c} - {number(middle)} * {y}) * {number(2 * nxt / half)} - {number(s * nxt)} * {c} AS {y}" for c, y in zip(old, new, strict=True)])
            s = nxt
        vals, u, cols, off = _ritz(cut(state.selectExpr("id", *[f"{y} AS {c}" for c, y in zip(old, new, strict=True)])), cols, apply, k)
    else:
        raise RuntimeError(f"eigenvectors didn't settle: residual {off}")
    return vals[:k], u.select("id", *cols[:k])


def lowrank_distributed(nodes: DataFrame, apply: Operator, top: float, k: int, sweeps: int, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """So many sweeps of randomised subspace iteration with top - A, as joins."""
    cols = [f"v{j}" for j in range(2 * k)]
    u = cut(_started(nodes, cols, seed))
    for _ in range(sweeps):
        u, cols = _orthonormal(u, cols)
        image = apply(u, cols).toDF("id", *[f"a_{c}" for c in cols])
        u = cut(u.join(image, "id").selectExpr("id", *[f"{number(top)} * {c} - a_{c} AS {c}" for c in cols]))
    vals, u, cols, _ = _ritz(u, cols, apply, k)
    return vals[:k], u.select("id", *cols[:k])


def eigen_decomp(nodes: DataFrame, edges: DataFrame, k: int = 10, kind: str = "normalized", method: str = "exact", gamma: float = 0.0, sweeps: int = 50, seed: int = 0, tol: float = 1e-6, plan: str = "auto", entries: int = blocks.ENTRIES) -> tuple[np.ndarray, DataFrame]:
    """Smallest k eigenvalues (ascending) and vectors (id, v0, v1, ...) of a Laplacian.

    kind: combinatorial, normalized, or randomwalk (its vectors are D^-1/2 of the normalized ones).
    exact: Chebyshev-filtered subspace iteration on packed blocks, to a residual of tol times the
    spectrum's bound; an error if it isn't reached.  lowrank: a fixed number of sweeps of randomised
    subspace iteration on the same blocks.  gamma > 0 adds the modularity term (gamma / sum of d) d d^T
    to the operator: on the blocks for the exact pairs of the combinatorial one without loops, else by joins.  plan "local" solves a graph of checked size in numpy.
    """
    spark = nodes.sparkSession
    if plan != "local":
        if gamma and method == "exact" and kind == "combinatorial" and edges.where("src = dst and w <> 0").isEmpty():
            most, total, squares = degrees(nodes, edges).agg(F.max("d"), F.sum("d"), F.sum(F.col("d") * F.col("d"))).first()
            vals, u, _ = blocks.smallest(nodes, cut(laplacian(nodes, edges)), k, tol, 0.0, 2 * most + gamma * squares / total, seed=seed, entries=entries, rho=gamma / total)
        elif gamma:
            apply, top = laplacian_operator(nodes, edges, kind, gamma)
            vals, u = smallest_distributed(nodes, apply, top, k, tol, seed=seed) if method == "exact" else lowrank_distributed(nodes, apply, top, k, sweeps, seed)
        else:
            a = cut(laplacian(nodes, edges, "combinatorial" if kind == "combinatorial" else "normalized"))
            top = blocks.bounds(a)[1] if kind == "combinatorial" else 2.0
            vals, u = blocks.smallest(nodes, a, k, tol, 0.0, top, seed=seed)[:2] if method == "exact" else blocks.lowrank(nodes, a, top, k, sweeps, seed=seed)
        if kind == "randomwalk":
            root = F.sqrt(F.when(F.col("d") > 0, F.col("d")).otherwise(1.0))
            u = u.join(degrees(nodes, edges), "id").select("id", *[(F.col(c) / root).alias(c) for c in u.columns[1:]])
        return vals, u
    g = local.gather(nodes, edges)
    vals, vecs = eigen_local(g, k, kind, method, gamma, sweeps, seed)
    return vals, local.frame(spark, g, vecs, "v")


def eigen_local(g: local.Local, k: int, kind: str = "normalized", method: str = "exact", gamma: float = 0.0, sweeps: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    d = g.degree
    base = g.laplacian("combinatorial" if kind == "combinatorial" else "normalized")
    m = d.sum()
    a = (lambda u: base(u) + (gamma / m) * (np.outer(d, d @ u) if u.ndim > 1 else d * (d @ u))) if gamma else base
    if method == "exact" and g.n <= local.MAX_DENSE:
        full = a(np.eye(g.n))
        vals, vecs = np.linalg.eigh((full + full.T) / 2)
        vals, vecs = vals[:k], vecs[:, :k]
    else:
        top = 2 * d.max() * (1 + gamma) if kind == "combinatorial" or gamma else 2.0
        vals, vecs = local.subspace(lambda u: top * u - a(u), g.n, k, sweeps if method == "lowrank" else 20_000, seed, tol=0.0 if method == "lowrank" else 1e-12)
        vals = top - vals
        off = np.sqrt(((a(vecs) - vecs * vals) ** 2).sum(0)).max()
        if method != "lowrank" and off > 1e-4 * top:
            raise RuntimeError(f"eigenvectors didn't settle: residual {off}")
    if kind == "randomwalk":
        vecs = vecs / np.sqrt(np.where(d > 0, d, 1))[:, None]
    return vals, vecs


def fiedler_vector(nodes: DataFrame, edges: DataFrame, tol: float = 1e-8, max_iter: int = 100_000, plan: str = "auto") -> DataFrame:
    """id, u: the second eigenvector of L; its value at the least id isn't positive.

    plan "local": power iteration on 2 max(d) I - L with the mean taken out, in numpy.
    """
    if plan != "local":
        _, v = eigen_decomp(nodes, edges, 2, "combinatorial", tol=tol)
        v = cut(v.select("id", F.col("v1").alias("u")))
        sign = -1.0 if v.agg(F.min_by("u", "id")).first()[0] > 0 else 1.0
        return v.select("id", (sign * F.col("u")).alias("u"))
    g = local.gather(nodes, edges)
    lap, top = g.laplacian(), 2 * g.degree.max()
    v = np.random.default_rng(0).normal(size=g.n)
    old = np.inf
    for _ in range(max_iter):
        v = top * v - lap(v)
        v -= v.mean()
        v /= np.linalg.norm(v)
        rayleigh = v @ lap(v)
        if abs(rayleigh - old) < tol:
            break
        old = rayleigh
    return local.frame(nodes.sparkSession, g, -v if v[0] > 0 else v)


def diffusion_map(nodes: DataFrame, edges: DataFrame, k: int = 2, steps: int = 1, alpha: float = 1.0, full: bool = False, plan: str = "auto") -> DataFrame:
    """Eigenvectors of the Coifman-Lafon walk, each times (1 - value) ** steps; without the trivial one unless full."""
    if plan != "local":
        d = degrees(nodes, edges).where("d > 0")
        h = edges
        for end in ("src", "dst"):
            h = h.join(d.select(F.col("id").alias(end), F.col("d").alias(f"d_{end}")), end)
        h = cut(h.select("src", "dst", (F.col("w") * F.pow(F.col("d_src") * F.col("d_dst"), F.lit(-float(alpha)))).alias("w")))
        vals, v = eigen_decomp(nodes, h, k, "randomwalk")
        return v.select("id", *[(F.col(f"v{j}") * float((1 - vals[j]) ** steps)).alias(f"v{j if full else j - 1}") for j in range(0 if full else 1, k)])
    g = local.gather(nodes, edges)
    d = np.where(g.degree > 0, g.degree, 1)
    h = g.with_weights(g.w * d[g.row] ** -alpha * d[g.col] ** -alpha)
    vals, vecs = eigen_local(h, k, "randomwalk")
    out = vecs * (1 - vals) ** steps
    return local.frame(nodes.sparkSession, g, out if full else out[:, 1:], "v")


def dirichlet_eigenvectors(nodes: DataFrame, a: DataFrame, boundary: DataFrame, k: int, tol: float = 1e-8, entries: int = blocks.ENTRIES) -> tuple[np.ndarray, DataFrame]:
    """Smallest eigenpairs of a symmetric matrix with zero values on a set: those of its free rows and columns, in blocks."""
    held = boundary.select("id").distinct()
    free = cut(nodes.select("id").join(held, "id", "left_anti"))
    inner = cut(a.join(free.select(F.col("id").alias("src")), "src", "left_semi").join(free.select(F.col("id").alias("dst")), "dst", "left_semi"))
    vals, u, _ = blocks.smallest(free, inner, k, tol, entries=entries)
    zero = nodes.select("id").join(held, "id", "left_semi").select("id", *[F.lit(0.0).alias(c) for c in u.columns[1:]])
    return vals, u.unionByName(zero)


def reweight_poisson(nodes: DataFrame, edges: DataFrame, train: DataFrame, normalized: bool = False, tol: float = 1e-5, plan: str = "auto") -> DataFrame:
    """diag(w) W diag(w) with L w = delta of the labelled nodes less its mean, shifted to a least value of 1e-5.

    Normalized: L is the normalized Laplacian, and the mean is weighted by the roots of the degrees,
    so that the right-hand side is orthogonal to the kernel of L.
    """
    if plan != "local":
        d = degrees(nodes, edges)
        f = cut(nodes.select("id").join(train.select("id", F.lit(1.0).alias("u")).distinct(), "id", "left").join(d, "id").select("id", F.sqrt("d").alias("r"), F.coalesce("u", F.lit(0.0)).alias("u")))
        mean = f.agg(F.sum(F.col("r") * F.col("u")) / F.sum("r") if normalized else F.avg("u")).first()[0]
        w = cut(conjgrad(nodes, cut(laplacian(nodes, edges, "normalized" if normalized else "combinatorial")), f.select("id", (F.col("u") - float(mean)).alias("u")), ["u"], tol, max_iter=10_000, plan=plan))
        w = w.select("id", (F.col("u") - float(w.agg(F.min("u")).first()[0]) + 1e-5).alias("u"))
        out = edges
        for end in ("src", "dst"):
            out = out.join(w.select(F.col("id").alias(end), F.col("u").alias(f"u_{end}")), end)
        return out.select("src", "dst", (F.col("u_src") * F.col("w") * F.col("u_dst")).alias("w"))
    g = local.gather(nodes, edges)
    at = g.index(train.select("id").distinct().toPandas()["id"].to_numpy())
    delta = np.zeros(g.n)
    delta[at] = 1.0
    if normalized:
        root = np.sqrt(g.degree)
        delta -= (root @ delta) / root.sum()
        w = local.conjgrad(g.laplacian("normalized"), delta, tol=tol)
    else:
        w = local.conjgrad(g.laplacian(), delta - delta.mean(), tol=tol)
    w = w - w.min() + 1e-5
    out = g.with_weights(w[g.row] * g.w * w[g.col])
    return edge_frame(nodes.sparkSession, out)


def edge_frame(spark, g: local.Local, values: np.ndarray | None = None, name: str = "w") -> DataFrame:
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"src": g.ids[g.row], "dst": g.ids[g.col], name: g.w if values is None else values}))
