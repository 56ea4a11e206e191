"""Sweeps to a fixed point on packed blocks, one and many, against the same equations in numpy."""

import numpy as np
import pytest

from weftgraph.operators import auction, blocks, local, nonlinear, ssl
from weftgraph.session import prepare

ONE, MANY = 1 << 22, 250


def table(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "src long, dst long, w double").cache()


@pytest.fixture(scope="module")
def graph(spark):
    """Fifty nodes in one part, and one node without edges."""
    prepare(spark)
    r, n = np.random.default_rng(3), 51
    w = np.triu((r.random((n, n)) < 0.15) * r.random((n, n)), 1)
    w[np.arange(49), np.arange(1, 50)] = 0.2
    w[:, 50] = 0
    w = w + w.T
    nodes, edges = spark.range(n).cache(), table(spark, w)
    wide = spark.createDataFrame([(0, 1.0, 0.0), (7, 0.0, 1.0), (20, 0.0, 0.0)], "id long, u0 double, u1 double")
    return nodes, edges, wide, local.gather(nodes, edges)


def columns(df, names=("u0", "u1")):
    return df.toPandas().sort_values("id")[list(names)].to_numpy()


AT, VALUES = np.array([0, 7, 20]), np.array([[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]])


@pytest.mark.parametrize("entries", [ONE, MANY])
@pytest.mark.parametrize("weighted", [False, True])
def test_extensions(graph, entries, weighted):
    nodes, edges, wide, g = graph
    got = columns(nonlinear.amle_blocks(nodes, edges, wide, ["u0", "u1"], weighted, 1e-6, entries=entries))
    for c in range(2):
        assert np.allclose(got[:, c], nonlinear.amle_local(g, AT, VALUES[:, c], weighted, 1e-6), atol=1e-4)


@pytest.mark.parametrize("entries", [ONE, MANY])
def test_plaplace(graph, entries):
    nodes, edges, wide, g = graph
    got = columns(nonlinear.plaplace_blocks(nodes, edges, wide, ["u0", "u1"], 10.0, 1e-8, entries=entries))
    for c in range(2):
        assert np.allclose(got[:, c], nonlinear.plaplace_local(g, AT, VALUES[:, c], 10.0, tol=1e-9), atol=1e-6)


@pytest.mark.parametrize("entries", [ONE, MANY])
@pytest.mark.parametrize("p", [0.5, 1.0, 2.0])
def test_arrivals(spark, graph, entries, p):
    nodes, edges, _, g = graph
    wide = spark.createDataFrame([(0, 0.0, None), (7, None, 0.5)], "id long, u0 double, u1 double")
    got = columns(nonlinear.peikonal_blocks(nodes, edges, wide, ["u0", "u1"], p, 1.5, entries=entries))
    for c, (at, value) in enumerate([(0, 0.0), (7, 0.5)]):
        want = nonlinear.peikonal_local(g, np.array([at]), np.array([value]), p, np.full(51, 1.5))
        assert np.isinf(got[50, c]) and np.isinf(want[50]) and np.allclose(got[:50, c], want[:50], atol=1e-7)


def test_classifiers_are_not_solved_on_the_driver(spark, graph, monkeypatch):
    nodes, edges, _, _ = graph
    monkeypatch.setattr(local, "gather", lambda *a: pytest.fail("gathered"))
    train = spark.createDataFrame([(0, 0), (7, 1)], "id long, label int")
    for model in (ssl.AMLE, ssl.PLaplace, ssl.PEikonal):
        assert model(ssl.Graph(nodes, edges)).fit_predict(train).count() == 51


def test_filter_moves_its_columns_only():
    """The factors of the filter, in their order, keep the Chebyshev polynomial's values."""
    x, roots = np.linspace(0.2, 2.0, 200), blocks._roots(0.2, 2.0, 24)
    got = np.prod([(x - r) / (0.0 - r) for r in roots], 0)
    want = np.cos(24 * np.arccos(np.clip((x - 1.1) / 0.9, -1, 1))) / np.cosh(24 * np.arccosh(1.1 / 0.9))
    assert np.abs(got - want).max() < 1e-12


@pytest.mark.parametrize("entries", [ONE, MANY])
def test_centered_kernel(spark, graph, entries):
    nodes, edges, _, g = graph
    train = spark.createDataFrame([(0, 0), (7, 1), (20, 1)], "id long, label int")
    model = ssl.CenteredKernel(ssl.Graph(nodes, edges), tol=1e-3, powers=200, alpha=2.0, entries=entries)
    got = columns(model._joins(train, ["u0", "u1"]))
    assert np.allclose(got, model._local(g, AT, np.array([0, 1, 1]), 2), atol=5e-3)


@pytest.mark.parametrize("entries", [ONE, MANY])
def test_sparse_propagation(spark, graph, monkeypatch, entries):
    nodes, edges, _, g = graph
    train = spark.createDataFrame([(0, 0), (7, 1), (20, 1)], "id long, label int")
    monkeypatch.setattr(ssl, "sparse_propagation", lambda *a, **more: pytest.fail("joins"))
    monkeypatch.setattr(local, "MAX_NODES", 10)
    got = ssl.SparseLabelPropagation(ssl.Graph(nodes, edges), rounds=6, entries=entries).fit(train).toPandas().sort_values(["id", "cls"])
    want = ssl.SparseLabelPropagation(None, rounds=6)._local(g, AT, np.array([0, 1, 1]), 2)
    assert np.allclose(got["u"].to_numpy().reshape(-1, 2), want, atol=1e-12)


def test_columns_are_swept_in_tasks_of_their_own(spark, graph):
    """Two columns of a block: no sweep sees both."""
    nodes, edges, wide, _ = graph

    def value(w, x, starts, u, more):
        assert x.shape[1] == 1
        return (np.minimum.reduceat(x, starts) + np.maximum.reduceat(x, starts)) / 2

    start = nonlinear._with_start(nodes, wide, ["u0", "u1"], [0.0, 0.0])
    got = columns(blocks.settle(nodes, edges, start, ["u0", "u1"], value, 1e-6, 10_000))
    assert np.allclose(got, columns(nonlinear.amle_blocks(nodes, edges, wide, ["u0", "u1"], tol=1e-6)), atol=1e-12)


def test_volume_mbo_beyond_one_driver(spark, graph, monkeypatch):
    nodes, edges, _, g = graph
    train, options = spark.createDataFrame([(0, 0), (7, 1), (20, 1)], "id long, label int"), {"priors": [1, 1], "rounds": 5}
    want = ssl.VolumeMBO(None, **options)._local(g, AT, np.array([0, 1, 1]), 2)
    monkeypatch.setattr(local, "MAX_NODES", 10)
    got = ssl.VolumeMBO(ssl.Graph(nodes, edges), plan="blocks", **options).fit(train).toPandas().sort_values(["id", "cls"])
    assert (got["u"].to_numpy().reshape(-1, 2) == want).all()


def test_prices_are_no_worse_than_bids():
    r = np.random.default_rng(0)
    for n, k in ((60, 3), (500, 10)):
        score, lower, upper = r.normal(size=(n, k)) + np.arange(k), np.full(k, n // k // 2), np.full(k, n // k + 3)
        y, z = auction.priced(score, lower, upper), auction.assign(score, lower, upper)
        size = np.bincount(y, minlength=k)
        assert (size >= lower).all() and (size <= upper).all()
        assert score[np.arange(n), y].sum() >= score[np.arange(n), z].sum() - 1e-9
    alike = auction.priced(np.zeros((30, 3)), np.zeros(3, int), np.full(3, 12))
    assert (np.bincount(alike, minlength=3) <= 12).all()
