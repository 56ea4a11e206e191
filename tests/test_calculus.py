"""Construction and calculus on graphs whose answers are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import calculus, weights
from weftgraph.operators.fixpoint import component_labels
from weftgraph.operators.knn import knn, knn_forest


def graph(spark, pairs, n, w=1.0):
    rows = [(a, b, w) for a, b in pairs] + [(b, a, w) for a, b in pairs]
    return spark.range(n).select("id"), spark.createDataFrame(rows or [(0, 0, 0.0)], "src long, dst long, w double").where("src <> dst")


def cloud(spark, n, d, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


@pytest.mark.parametrize("similarity", ["euclidean", "angular", "manhattan", "hamming", "dot"])
def test_knn_is_brute_force(spark, similarity):
    x, p = cloud(spark, 60, 3)
    x = np.round(x) if similarity == "hamming" else x
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    y = x / np.linalg.norm(x, axis=1, keepdims=True) if similarity == "angular" else x
    gap = y[:, None] - y[None]
    d = {"manhattan": np.abs(gap).sum(2), "hamming": (gap != 0).sum(2), "dot": -(y @ y.T)}.get(similarity, np.sqrt((gap**2).sum(2)))
    got = {(r.src, r.rank): r.dst for r in knn(p, 4, similarity).collect()}
    for i in range(60):
        order = sorted((round(float(d[i, j]), 9), j) for j in range(60) if j != i)[:4]
        assert [got[i, r + 1] for r in range(4)] == [j for _, j in order]


def test_forest_recall_and_equal_points(spark):
    x, p = cloud(spark, 600, 8, 1)
    exact = {(r.src, r.dst) for r in knn(p, 5, method="exact").collect()}
    near = {(r.src, r.dst) for r in knn_forest(p, 5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    same = spark.range(50).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    assert knn_forest(same, 3).count() == 150


def test_few_points(spark):
    _, p = cloud(spark, 3, 2)
    assert knn(p, 10).count() == 6
    assert knn(p.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        knn(p, 1, "cosine")


def test_weights_are_proper(spark):
    _, p = cloud(spark, 80, 3)
    for kernel in ("uniform", "gaussian", "symgaussian", "distance", "singular"):
        e = weights.knn_graph(p, 6, kernel)
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.round("w", 12).alias("v"))
        assert e.where("src = dst or w = 0").isEmpty()
        assert e.join(back, ["src", "dst"]).where(F.abs(F.col("v") - F.col("w")) < 1e-9).count() == e.count()


def test_epsilon_ball_is_brute_force(spark):
    x, p = cloud(spark, 120, 2, 2)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(i, j) for i in range(120) for j in range(120) if i != j and d[i, j] <= 0.4}
    assert {(r.src, r.dst) for r in weights.epsilon_ball(p, 0.4, "uniform").collect()} == want


def test_grid_graph(spark):
    assert weights.grid_graph(spark, 3, 4).count() == 2 * (3 * 3 + 2 * 4)


def test_laplacian_rows_sum_to_zero_and_isolated_nodes_stay(spark):
    nodes, edges = graph(spark, [(0, 1), (1, 2), (2, 0)], 4)
    for kind in ("combinatorial", "randomwalk", "coifmanlafon"):
        sums = calculus.laplacian(nodes, edges, kind).groupBy("src").agg(F.sum("w").alias("s")).where("src < 3").collect()
        assert all(abs(r.s) < 1e-12 for r in sums)
    assert {(r.id, r.d) for r in calculus.degrees(nodes, edges).collect()} == {(0, 2.0), (1, 2.0), (2, 2.0), (3, 0.0)}


def test_gradient_and_divergence_are_adjoint(spark):
    rng = np.random.default_rng(3)
    nodes, edges = graph(spark, [(i, j) for i in range(6) for j in range(i) if (i + j) % 2], 6)
    u = spark.createDataFrame([(i, float(rng.normal())) for i in range(6)], "id long, u double")
    v = edges.select("src", "dst", F.sin(F.col("src") * 3 + F.col("dst")).alias("v"))
    left = calculus.gradient(edges, u).withColumnRenamed("v", "g").join(v, ["src", "dst"]).join(edges, ["src", "dst"]).agg((F.sum(F.col("g") * F.col("v") * F.col("w")) / 2).alias("s")).first().s
    right = -calculus.divergence(nodes, edges, v).withColumnRenamed("u", "q").join(u, "id").agg(F.sum(F.col("q") * F.col("u")).alias("s")).first().s
    assert abs(left - right) < 1e-9


def test_subgraph_is_relabelled(spark):
    nodes, edges = graph(spark, [(0, 1), (1, 2), (2, 3), (3, 0)], 4)
    n, e = calculus.subgraph(nodes, edges, spark.createDataFrame([(1,), (2,), (3,)], "id long"), relabel=True)
    assert sorted(r.id for r in n.collect()) == [0, 1, 2]
    assert {(r.src, r.dst) for r in e.collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 42), (50, 51)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = {r.id: r.component for r in component_labels(edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[42] == 40 and got[51] == 50 and len(got) == 36
    assert component_labels(edges.limit(0)).count() == 0


def test_infinity_laplacian_of_a_path(spark):
    nodes, edges = graph(spark, [(0, 1), (1, 2)], 3)
    u = spark.createDataFrame([(0, 0.0), (1, 2.0), (2, 3.0)], "id long, u double")
    assert {r.id: r.u for r in calculus.infinity_laplacian(nodes, edges, u).collect()} == {0: 2.0, 1: -1.0, 2: -1.0}


def test_random_weights_don_t_depend_on_partitions(spark):
    _, edges = graph(spark, [(0, 1), (1, 2)], 3)
    a, b = (sorted(map(tuple, calculus.random_weights(e, "normal", 1).collect())) for e in (edges, edges.repartition(3)))
    assert a == b


@pytest.mark.parametrize("cell", [4096, 16, 1])
def test_dense_cells_of_the_radius_graph_are_split(spark, monkeypatch, cell):
    """The pairs of a plain search, each once, where a cell holds a third of the points and equal ones, whole and in parts."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.uniform(0.01, 0.19, (60, 2)), rng.uniform(-1, 1, (110, 2)), np.full((10, 2), 0.05)])
    p = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    monkeypatch.setattr(weights, "CELL", cell)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.2
    np.fill_diagonal(near, False)
    got = [(r.src, r.dst) for r in weights.epsilon_ball(p, 0.2, "uniform").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i * 3, j * 3) for i, j in np.argwhere(near).tolist()}
