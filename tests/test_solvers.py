"""Solvers are put back into their equations, or compared with dense numpy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import calculus, linear, local, nonlinear, paths, weights


@pytest.fixture(scope="module")
def small(spark):
    x = np.random.default_rng(0).uniform(size=(40, 2))
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    nodes, edges = p.select("id"), weights.knn_graph(p, 6).cache()
    w = np.zeros((40, 40))
    for r in edges.collect():
        w[r.src, r.dst] = r.w
    return nodes, edges, w


def column(df, n=40, name="u"):
    out = np.full(n, np.nan)
    for r in df.collect():
        out[r.id] = r[name]
    return out


@pytest.mark.parametrize("plan", ["local", "distributed"])
def test_conjgrad(spark, small, plan):
    nodes, edges, w = small
    a = np.diag(w.sum(1) + 1) - w
    entries = calculus.laplacian(nodes, edges).unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    b = nodes.select("id", F.sin("id").alias("a"), F.when(F.col("id") == 3, 1.0).otherwise(0.0).alias("b"))
    got = linear.conjgrad(nodes, entries, b, ["a", "b"], 1e-5, plan=plan)
    assert np.allclose(a @ column(got, name="a"), np.sin(np.arange(40)), atol=1e-4)
    assert np.allclose(a @ column(got, name="b"), np.arange(40) == 3, atol=1e-4)


def test_constrained_solve_is_harmonic(spark, small):
    nodes, edges, w = small
    bdy = spark.createDataFrame([(0, 0.0), (1, 1.0)], "id long, u double")
    u = column(linear.constrained_solve(nodes, calculus.laplacian(nodes, edges), None, bdy, ["u"], 1e-10))
    lap = np.diag(w.sum(1)) - w
    assert u[0] == 0 and u[1] == 1 and np.abs((lap @ u)[2:]).max() < 1e-6 and u.min() >= -1e-9 and u.max() <= 1 + 1e-9
    eye = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    v = column(linear.constrained_solve_gmres(nodes, calculus.laplacian(nodes, edges), None, eye, bdy.withColumnRenamed("u", "g")))
    assert np.allclose(u, v, atol=1e-6)


def test_page_rank(spark, small):
    nodes, edges, w = small
    u = np.full(40, 1 / 40)
    for _ in range(500):
        u = 0.85 * w.T @ (u / w.sum(1)) + 0.15 / 40
    assert np.allclose(column(linear.page_rank(nodes, edges, tol=1e-8)), u, atol=1e-7)


def test_shortest_paths(spark, small):
    nodes, edges, w = small
    d = np.where(w > 0, 1 / np.where(w > 0, w, 1), np.inf)
    np.fill_diagonal(d, 0)
    for k in range(40):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    start = spark.createDataFrame([(0, 0.0), (5, 0.2)], "id long, g double")
    got = paths.dijkstra(nodes, edges, start, reciprocal=True)
    assert np.allclose(column(got, name="d"), np.minimum(d[0], d[5] + 0.2))
    assert np.isclose(paths.distance(nodes, edges, 0, 17), d[0, 17])
    length, walk = paths.distance(nodes, edges, 0, 17, path=True)
    assert walk[0] == 0 and walk[-1] == 17 and np.isclose(sum(1 / w[a, b] for a, b in zip(walk, walk[1:], strict=False)), length)
    near = column(paths.dijkstra(nodes, edges, start, reciprocal=True, max_dist=5.0), name="d")
    assert np.isinf(near[np.minimum(d[0], d[5] + 0.2) > 5]).all()


def test_distance_matrix_is_centred(spark):
    nodes = spark.range(4).select("id")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 0.5), (2, 1, 0.5), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    t = np.zeros((4, 4))
    for r in paths.distance_matrix(nodes, edges).collect():
        t[r.source, r.id] = r.d
    assert t[0].tolist() == [0, 1, 3, 4]
    j = np.eye(4) - 0.25
    c = np.zeros((4, 4))
    for r in paths.distance_matrix(nodes, edges, centered=True).collect():
        c[r.source, r.id] = r.d
    assert np.allclose(c, -0.5 * j @ t @ j)


def test_nonlinear_equations(spark, small):
    nodes, edges, w = small
    bdy = spark.createDataFrame([(0, 0.0), (1, 1.0)], "id long, g double")
    lo = lambda u: np.array([u[w[i] > 0].min() for i in range(40)])
    hi = lambda u: np.array([u[w[i] > 0].max() for i in range(40)])
    u = column(nonlinear.amle(nodes, edges, bdy, tol=1e-10))
    assert np.abs((u - (lo(u) + hi(u)) / 2)[2:]).max() < 1e-7
    u = column(nonlinear.amle(nodes, edges, bdy, weighted=True, tol=1e-9))
    slope = [(w[i] * (u - u[i]))[w[i] > 0] for i in range(40)]
    assert max(abs(s.min() + s.max()) for s in slope[2:]) < 1e-6
    u = column(nonlinear.plaplace(nodes, edges, bdy, 4.0, tol=1e-10))
    assert np.abs((u - (w @ u / w.sum(1) / 3 + 2 / 3 * (lo(u) + hi(u)) / 2))[2:]).max() < 1e-7
    u = column(nonlinear.plaplace(nodes, edges, bdy, 4.0, fast=False, tol=1e-6))
    slope = [w[i] * (u - u[i]) for i in range(40)]
    gap = [s.sum() / (4 * w[i].sum()) + 0.5 * (min(s.min(), 0) + max(s.max(), 0)) for i, s in enumerate(slope)]
    assert np.abs(gap[2:]).max() < 1e-4


@pytest.mark.parametrize("p", [1.0, 2.0])
def test_eikonal_equation(spark, small, p):
    nodes, edges, w = small
    bdy = spark.createDataFrame([(0, 0.0)], "id long, g double")
    u = column(nonlinear.peikonal(nodes, edges, bdy, p))
    assert np.abs(np.array([(w[i] * np.maximum(u[i] - u, 0) ** p).sum() for i in range(1, 40)]) - 1).max() < 1e-6
    if p == 1:
        assert np.allclose(column(nonlinear.peikonal_p1(nodes, edges, bdy)), u, atol=1e-7)


def test_eigenpairs(spark, small):
    nodes, edges, w = small
    d = w.sum(1)
    lap = np.eye(40) - w / np.sqrt(d[:, None] * d[None])
    want = np.linalg.eigvalsh(lap)[:4]
    vals, vecs = linear.eigen_decomp(nodes, edges, 4)
    assert np.allclose(vals, want)
    v = np.stack([column(vecs, name=f"v{j}") for j in range(4)], 1)
    assert np.abs(lap @ v - v * vals).max() < 1e-5
    assert np.allclose(linear.eigen_decomp(nodes, edges, 4, method="lowrank", sweeps=300)[0], want, atol=1e-4)
    f = column(linear.fiedler_vector(nodes, edges, tol=1e-14))
    vals, vecs = np.linalg.eigh(np.diag(d) - w)
    assert abs(abs(f @ vecs[:, 1]) - 1) < 1e-3 and f[0] <= 0


@pytest.mark.parametrize(("kind", "gamma"), [("randomwalk", 0.0), pytest.param("combinatorial", 0.5, marks=pytest.mark.skipif(not os.environ.get("WEFTGRAPH_SLOW"), reason="products with the modularity term are joins, which take minutes"))])
def test_distributed_eigenpairs(spark, small, kind, gamma):
    nodes, edges, w = small
    d = w.sum(1)
    lap = np.diag(d) - w + gamma / d.sum() * np.outer(d, d) if kind == "combinatorial" else np.eye(40) - w / (np.sqrt(d[:, None] * d[None]) if kind == "normalized" else d[:, None])
    want = np.sort(np.linalg.eigvals(lap).real)[:2]
    vals, vecs = linear.eigen_decomp(nodes, edges, 2, kind, gamma=gamma, tol=1e-4, plan="distributed")
    assert np.allclose(vals, want, atol=1e-5)
    v = np.stack([column(vecs, name=f"v{j}") for j in range(2)], 1)
    assert np.abs(lap @ v - v * vals).max() < 1e-2


def test_distributed_reweighting(spark, small):
    nodes, edges, w = small
    d = w.sum(1)
    train = spark.createDataFrame([(0, 0), (7, 1), (9, 1)], "id long, label int")
    key = lambda r: (r.src, r.dst)
    f = np.zeros(40)
    f[[0, 7, 9]] = 1
    f -= np.sum(np.sqrt(d) * f) / np.sqrt(d).sum()
    lap = np.eye(40) - w / np.sqrt(d[:, None] * d[None])
    x, y = (np.array([r.w for r in sorted(linear.reweight_poisson(nodes, edges, train, True, tol=t, plan=p).collect(), key=key)]) for p, t in (("local", 1e-10), ("distributed", 1e-2)))
    assert np.allclose(x, y, rtol=0.05, atol=1e-2)
    # the solution that is orthogonal to the roots of the degrees, as the iteration from zero gives it
    u = np.linalg.lstsq(lap, f, rcond=None)[0]
    u = u - u.min() + 1e-5
    assert np.allclose(x, [u[r.src] * w[r.src, r.dst] * u[r.dst] for r in sorted(edges.collect(), key=key)], rtol=1e-3, atol=1e-7)


@pytest.mark.parametrize("weighted", [False, True])
def test_extension_as_joins(spark, small, weighted):
    nodes, edges, _ = small
    wide = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 0.0), (5, 0.5, 0.5)], "id long, u0 double, u1 double")
    got = nonlinear.amle_joins(nodes, edges, wide, ["u0", "u1"], weighted, rounds=3)
    g = local.gather(nodes, edges)
    for c, value in (("u0", [0.0, 1.0, 0.5]), ("u1", [1.0, 0.0, 0.5])):
        assert np.allclose(column(got, name=c), nonlinear.amle_local(g, np.array([0, 1, 5]), np.array(value), weighted, -1.0, 3), atol=1e-7)


@pytest.mark.parametrize("p", [1.0, 2.0])
def test_eikonal_equation_as_joins(spark, small, p):
    nodes, edges, w = small
    wide = spark.createDataFrame([(0, 0.0, None), (1, None, 0.0)], "id long, u0 double, u1 double")
    got = nonlinear.peikonal_joins(nodes, edges, wide, ["u0", "u1"], p, tol=1e-9)
    for at, c in ((0, "u0"), (1, "u1")):
        want = column(nonlinear.peikonal(nodes, edges, spark.createDataFrame([(at, 0.0)], "id long, g double"), p))
        assert np.allclose(column(got, name=c), want, atol=1e-6)


def test_largest_component(spark):
    from weftgraph.operators import fixpoint

    nodes = spark.range(8).select("id")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (3, 4, 1.0), (4, 3, 1.0), (4, 5, 2.0), (5, 4, 2.0)], "src long, dst long, w double")
    own, inner, mask = fixpoint.largest_component(nodes, edges)
    assert sorted(r.id for r in own.collect()) == [3, 4, 5] and inner.count() == 4
    assert {r.id for r in mask.where("inside").collect()} == {3, 4, 5} and mask.count() == 8


def test_hungarian_and_kmeans():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n in (1, 3, 5):
        c = rng.normal(size=(n, n))
        best = min(permutations(range(n)), key=lambda p: sum(c[i, p[i]] for i in range(n)))
        assert local.hungarian(c).tolist() == list(best)
    x = np.concatenate([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2))])
    y = local.kmeans(x, 2)
    assert len(set(y[:20])) == 1 and len(set(y[20:])) == 1 and y[0] != y[20]


def test_size_is_checked(spark, monkeypatch, small):
    monkeypatch.setattr(local, "MAX_NODES", 10)
    with pytest.raises(ValueError):
        local.gather(small[0], small[1])


def test_fronts_join_few_edges(spark):
    """A long grid: the distances of Dijkstra's algorithm, and joined rows of a small multiple of the edges."""
    import heapq

    from weftgraph.operators import paths

    r, width, height = np.random.default_rng(2), 40, 6
    at = lambda x, y: x * height + y
    pairs = [(at(x, y), at(x + dx, y + dy)) for x in range(width) for y in range(height) for dx, dy in ((0, 1), (1, 0)) if x + dx < width and y + dy < height]
    length = {p: float(v) for p, v in zip(pairs, r.uniform(0.5, 1.5, len(pairs)), strict=True)}
    length |= {(b, a): v for (a, b), v in length.items()}
    edges = spark.createDataFrame([(a, b, v) for (a, b), v in length.items()], "src long, dst long, w double")
    near: dict = {}
    for (a, b), v in length.items():
        near.setdefault(a, []).append((b, v))
    want, todo = {}, [(0.0, 0)]
    while todo:
        d, a = heapq.heappop(todo)
        if a not in want:
            want[a] = d
            for b, v in near[a]:
                heapq.heappush(todo, (d + v, b))
    stats: dict = {}
    got = paths.dijkstra(spark.range(width * height + 1), edges, spark.createDataFrame([(0, 0.0)], "id long, g double"), stats=stats)
    got = {x.id: x.d for x in got.collect()}
    assert got.pop(width * height) == np.inf and max(abs(got[i] - want[i]) for i in want) < 1e-12
    assert stats["joined"] <= 2.5 * len(length)


@pytest.mark.parametrize("p", [1.0, 2.0])
def test_eikonal_starts_from_an_upper_solution(spark, small, p):
    """From u0 the equation has the same solution, in numpy and as joins, in fewer rounds where u0 is near."""
    nodes, edges, _ = small
    boundary = spark.createDataFrame([(0, 0.0), (5, 0.2)], "id long, g double")
    want = nonlinear.peikonal(nodes, edges, boundary, p).cache()
    above = want.select("id", (F.col("u") + 0.01 * (F.col("id") % 5)).alias("u"))
    warm = nonlinear.peikonal(nodes, edges, boundary, p, u0=above)
    assert np.allclose(column(warm), column(want), atol=1e-6)
    joined = nonlinear.peikonal_joins(nodes, edges, boundary.withColumnRenamed("g", "u"), ["u"], p, u0=want, tol=1e-6)
    assert np.allclose(column(joined), column(want), atol=1e-5)
    settled = nonlinear.peikonal_joins(nodes, edges, boundary.withColumnRenamed("g", "u"), ["u"], p, u0=want, rounds=1)
    assert np.allclose(column(settled), column(want), atol=1e-6)


def test_boundary_values_from_numbers_and_tables(spark, small):
    """Ids that are no nodes and repeated ids fall away; of values given twice the least holds."""
    nodes, edges, _ = small
    ids = spark.createDataFrame([(3,), (3,), (7,), (99,)], "id long")
    assert sorted(map(tuple, nonlinear.boundary_frame(nodes, ids, 0.5).collect())) == [(3, 0.5), (7, 0.5)]
    g = spark.createDataFrame([(3, 2.0), (3, 1.0), (8, 4.0)], "id long, g double")
    own = nonlinear.boundary_frame(nodes, ids, g)
    assert sorted(map(tuple, own.collect())) == [(3, 1.0), (3, 2.0)]
    assert column(nonlinear.amle(nodes, edges, own.unionByName(spark.createDataFrame([(7, 0.0)], "id long, g double"))))[3] == 1.0
