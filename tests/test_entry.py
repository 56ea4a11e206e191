"""The entry points, and every query that has SQL against DuckDB on the small tables."""

import os

import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = __import__("weftgraph.plans.registry", fromlist=["x"])
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(r[i] for i in order)) for r in data)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "d"] and df.count() > 0


def test_sql_is_of_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(CORE.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DIR)
    cur = duck.execute(CORE.oracle_sql()[name])
    assert rows(df.columns, map(tuple, df.collect())) == rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["knn_euclidean", "knn_angular", "knn_manhattan", "knn_hamming", "knn_dot"])
def test_exact_neighbours_in_cells_and_blocks(spark, duck, monkeypatch, name):
    from weftgraph.operators import knn

    monkeypatch.setattr(knn, "BLOCK", 90)
    df = __spark_entry__.queries()[name](spark, DIR)
    cur = duck.execute(CORE.oracle_sql()[name])
    assert {tuple(r) for r in df.select(*[c[0] for c in cur.description]).collect()} == set(cur.fetchall())


def test_searching_points_are_sent_to_few_blocks(spark, monkeypatch):
    """Random points, where no cell can be left out: four times the points are sent to no more blocks each, and the neighbours are those of all pairs."""
    import numpy as np

    from weftgraph.operators import knn

    monkeypatch.setattr(knn, "BLOCK", 8)
    made = {}
    for n in (300, 1200):
        x = np.random.default_rng(n).normal(size=(n, 24))
        points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
        got = knn.knn_exact(points, 5)
        want = knn.nearest(np.arange(n), x, np.arange(n), x, 5, "euclidean")
        assert {(r.src, r.dst) for r in got.collect()} == set(zip(want["src"], want["dst"], strict=True))
        made[n] = {}
        knn.knn_exact(points, 5, stats=made[n])
    assert made[1200]["blocks"] <= made[300]["blocks"] * 1.5


def test_features_travel_with_points(spark):
    """The features of a radius graph are joined to points; a join to pairs would send them once for each."""
    plan = __spark_entry__.queries()["eps_ball_features"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    pairs = [line for line in plan.splitlines() if "Join" in line and ("src#" in line or "dst#" in line)]
    assert not any("src#" in line and "dst#" not in line for line in pairs) and not any("dst#" in line and "src#" not in line for line in pairs)


@pytest.mark.parametrize("name", ["model_change", "model_change_var_opt"])
def test_the_graph_is_made_once(spark, monkeypatch, name):
    from weftgraph.plans import decisions

    made, real = [], decisions.graph
    monkeypatch.setattr(decisions, "graph", lambda *a: made.append(1) or real(*a))
    __spark_entry__.queries()[name](spark, DIR)
    assert len(made) == 1


@pytest.mark.parametrize("similarity", ["euclidean", "angular", "manhattan", "hamming", "dot"])
def test_clusters_are_searched_in_few_cells(spark, monkeypatch, similarity):
    """Planted clusters with equal points and ties: the same neighbours as all pairs, most cells left out."""
    import numpy as np

    from weftgraph.operators import knn

    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(12, 6)) * 20, 60, axis=0) + rng.normal(size=(720, 6))
    x[100:260] = x[100]  # a cell of equal points
    x = np.round(x) if similarity == "hamming" else x
    points = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    monkeypatch.setattr(knn, "BLOCK", 60)
    stats = {}
    got = {(r.src, r.dst, r["rank"]): r.dist for r in knn.knn_exact(points, 7, similarity, stats=stats).collect()}
    ids = np.arange(720) * 3
    want = knn.nearest(ids, x, ids, x, 7, similarity)
    rank = want.groupby("src").cumcount() + 1
    keys = set(zip(want["src"], want["dst"], rank, strict=True))
    assert set(got) == keys
    if similarity in ("euclidean", "manhattan"):
        assert stats["share"] < 0.3
