"""Packed blocks against dense matrices: products across blocks, eigenpairs, solvers; with one block and with many."""

import numpy as np
import pytest

from weftgraph.operators import blocks, cluster, linear, ssl
from weftgraph.operators.calculus import laplacian
from weftgraph.session import prepare

ONE, MANY = 1 << 19, 90


def table(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "src long, dst long, w double").cache()


def column(df, name):
    return np.array([x for _, x in sorted((r.id, r[name]) for r in df.collect())])


@pytest.fixture(scope="module")
def graph(spark):
    prepare(spark)
    r, n = np.random.default_rng(3), 40
    w = np.triu((r.random((n, n)) < 0.2) * r.random((n, n)), 1)
    w[0, 1:] = 0.1  # one node that has all the others
    w = w + w.T
    return spark.range(n).cache(), table(spark, w), w


@pytest.mark.parametrize("entries", [ONE, MANY])
def test_products(spark, graph, entries):
    nodes, edges, w = graph
    m = blocks.Blocks(nodes, edges, entries)
    assert (m.count == 1) == (entries == ONE)
    x = blocks.started(np.arange(40), 3, 5)
    stay = lambda b, own, halo: own
    times = lambda b, own, halo: b.times(own, halo)
    state = m.steps(m.start(lambda ids: blocks.started(ids, 3, 5)), [stay, times, times], 3)
    got = m.frame(state, np.eye(3), ["a", "b", "c"])
    assert np.allclose(np.stack([column(got, c) for c in "abc"], 1), w @ w @ x)
    assert np.allclose(m.gram(state, 3), (w @ w @ x).T @ (w @ w @ x))


def test_empty_and_isolated(spark):
    none = spark.createDataFrame([], "src long, dst long, w double")
    vals, u, _ = blocks.smallest(spark.range(0), none, 2)
    assert len(vals) == 0 and u.count() == 0 and u.columns == ["id", "v0", "v1"]
    x = blocks.conjgrad(spark.range(3), spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0)], "src long, dst long, w double"), spark.createDataFrame([(1, 8.0), (7, 1.0)], "id long, u double"), ["u"])
    assert column(x, "u").tolist() == [0.0, 2.0, 0.0]


@pytest.mark.parametrize("entries", [ONE, MANY])
def test_eigenpairs(spark, graph, entries):
    nodes, edges, w = graph
    d = w.sum(1)
    lap = np.diag(d) - w
    a = laplacian(nodes, edges).cache()
    vals, u, off = blocks.smallest(nodes, a, 4, 1e-7, entries=entries)
    assert np.allclose(vals, np.linalg.eigvalsh(lap)[:4], atol=1e-8) and off < 1e-5
    v = np.stack([column(u, f"v{j}") for j in range(4)], 1)
    assert np.abs(lap @ v - v * vals).max() < 1e-5 and np.allclose(v.T @ v, np.eye(4), atol=1e-9)
    r = blocks.residuals(nodes, a, vals, u)
    assert np.allclose(np.stack([column(r, f"r{j}") for j in range(4)], 1), lap @ v - v * vals)
    held = spark.createDataFrame([(3,), (17,)], "id long")
    vals, u = linear.dirichlet_eigenvectors(nodes, a, held, 3, entries=entries)
    free = [i for i in range(40) if i not in (3, 17)]
    assert np.allclose(vals, np.linalg.eigvalsh(lap[np.ix_(free, free)])[:3], atol=1e-8) and column(u, "v0")[[3, 17]].tolist() == [0, 0]


@pytest.mark.parametrize("entries", [ONE, MANY])
def test_solvers(spark, graph, entries):
    nodes, _, w = graph
    a = np.diag(w.sum(1) + 1) - w
    b = np.random.default_rng(1).normal(size=(40, 2))
    rhs = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "id long, p double, q double")
    x = blocks.conjgrad(nodes, table(spark, a), rhs, ["p", "q"], 1e-9, entries=entries)
    assert np.allclose(np.stack([column(x, "p"), column(x, "q")], 1), np.linalg.solve(a, b))
    free, want = [i for i in range(40) if i not in (3, 17)], np.zeros(40)
    want[free] = np.linalg.solve((a @ a)[np.ix_(free, free)], b[free, 0])
    x = blocks.conjgrad(nodes, table(spark, a), rhs, ["p"], 1e-9, power=2, held=spark.createDataFrame([(3,), (17,)], "id long"), entries=entries)
    assert np.allclose(column(x, "p"), want)
    turned = a + np.triu(w, 1) * 0.5
    x, off = blocks.gmres(nodes, table(spark, turned), rhs.selectExpr("id", "p AS u"), 1e-7, restart=12, entries=entries)
    assert np.allclose(column(x, "u"), np.linalg.solve(turned, b[:, 0]), atol=1e-6) and off == sorted(off, reverse=True)


@pytest.mark.parametrize("entries", [ONE, MANY])
def test_exponential(spark, graph, entries):
    nodes, edges, w = graph
    rho = np.linspace(0.5, 2, 40)
    q = cluster.generator(nodes, edges, 0.3, spark.createDataFrame([(i, float(x)) for i, x in enumerate(rho)], "id long, rho double"))
    up = np.maximum(w * (1 / rho[:, None] - 1 / rho[None]), 0)
    d = w.sum(1)
    wa = w / d[:, None] / d[None]
    dense = 0.3 * (up - np.diag(up.sum(1))) + 0.7 * (wa / wa.sum(1)[:, None] - np.eye(40))
    m, state = blocks.exponential(nodes, q, 2.0, lambda ids: np.eye(40)[ids], 40, entries=entries)
    names = [f"v{j}" for j in range(40)]
    got = m.frame(state, np.eye(80)[:, :40], names).toPandas().sort_values("id")[names].to_numpy()
    assert np.abs(got - cluster._expm(dense * 2.0)).max() < 1e-12 and np.allclose(got.sum(1), 1)


def test_two_clouds_are_told_apart(spark):
    """Planted communities, in many blocks: labels by each kind of spectral clustering, and what models make of two labels."""
    r, n = np.random.default_rng(0), 240
    side = np.arange(n) % 3
    w = np.triu(np.where(side[:, None] == side[None], r.random((n, n)) < 0.2, r.random((n, n)) < 0.01), 1).astype(float)
    nodes, edges = spark.range(n).cache(), table(spark, w + w.T)
    for method in ("combinatorial", "ShiMalik", "NgJordanWeiss"):
        got = column(cluster.spectral(nodes, edges, 3, method), "cluster").astype(int)
        assert sum(np.bincount(got[side == c], minlength=3).max() for c in range(3)) >= 0.95 * n, method
    train = spark.createDataFrame([(c, c) for c in range(3)] + [(c + 3, c) for c in range(3)], "id long, label int")
    for model in (ssl.Laplace(ssl.Graph(nodes, edges), order=2, tau=0.01), ssl.Poisson(ssl.Graph(nodes, edges)), ssl.RandomWalk(ssl.Graph(nodes, edges))):
        got = {x.id: x.label for x in model.fit_predict(train).collect()}
        assert np.mean([got[i] == side[i] for i in range(n)]) >= 0.95


@pytest.mark.parametrize("entries", [ONE, MANY])
def test_modularity_eigenpairs(spark, graph, entries):
    nodes, edges, w = graph
    d = w.sum(1)
    vals, u = linear.eigen_decomp(nodes, edges, 4, "combinatorial", gamma=0.5, tol=1e-8, entries=entries)
    dense = np.diag(d) - w + 0.5 / d.sum() * np.outer(d, d)
    assert np.allclose(vals, np.linalg.eigvalsh(dense)[:4], atol=1e-7)
    v = np.stack([column(u, f"v{j}") for j in range(4)], 1)
    assert np.abs(dense @ v - v * vals).max() < 1e-5


@pytest.mark.parametrize("entries", [ONE, MANY])
def test_poisson_mbo_in_blocks(spark, graph, entries):
    """In one block and in several the classes of the numpy plan; no job for each heat step or move of a weight."""
    nodes, edges, w = graph
    train = spark.createDataFrame([(0, 0), (7, 1), (21, 2)], "id long, label int")
    g = ssl.Graph(nodes, edges)
    options = {"rounds": 2, "steps": 3, "priors": [0.3, 0.4, 0.3], "tol": 1e-10}
    here = ssl.PoissonMBO(g, plan="local", **options)._scores(train, 3)
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    there = ssl.PoissonMBO(g, entries=entries, **options)._scores(train, 3).collect()
    assert sorted(map(tuple, there)) == sorted(map(tuple, here.collect()))
    assert entries == MANY or spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before < 200


def test_weights_move_as_with_full_counts(spark, monkeypatch):
    """The moves of full counts to the last bit, by few passes; also where weights fall below zero and nothing settles."""
    rng = np.random.default_rng(0)
    one_hot = np.eye(4)[rng.integers(0, 4, 400)]
    for u, most, moves in ((rng.random((50, 4)), 10, 500), (rng.random((4000, 4)), 300, 500), (np.where(rng.random((900, 4)) < 0.6, 0.0, rng.random((900, 4))), 100, 500), (one_hot, 100, 3000)):
        priors, calls = np.array([0.1, 0.2, 0.3, 0.4]), []
        u = (u - u.min()) / (u.max() - u.min())
        w = np.ones(4)
        for _ in range(moves):
            gap = np.bincount((u * w).argmax(1), minlength=4) / len(u) - priors
            if np.abs(gap).max() <= 1e-3:
                break
            w = w - 0.1 * gap
            w = w / w[0]
        got = ssl._moved_weights(lambda w, r, u=u, calls=calls: calls.append(w) or ssl._sizes_of(u, w, r), len(u), priors, max_iter=moves, most=most)
        assert (got == w).all() and len(calls) < moves / 2


def test_multiclass_mbo_in_one_pass_a_round(spark, graph):
    nodes, edges, w = graph
    train = spark.createDataFrame([(0, 0), (7, 1), (21, 2)], "id long, label int")
    g = ssl.Graph(nodes, edges)
    here = ssl.MulticlassMBO(g, plan="local", eigenpairs=8, rounds=3).fit(train)
    there = ssl.MulticlassMBO(g, eigenpairs=8, rounds=3).fit(train)
    assert sorted(map(tuple, there.collect())) == sorted(map(tuple, here.collect()))
