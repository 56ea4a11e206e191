"""The radius graph on packed cells: pairs each once and both ways, and rounding without decimals."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from weftgraph.operators import weights
from weftgraph.plans.construction import _rounded
from weftgraph.session import prepare

DIR = "/root/testdata/sf0.001"


def test_features_by_products_and_directly(spark, monkeypatch):
    """Weights of a plain search, with features that are equal, nearly equal and far; cells whole and in parts."""
    prepare(spark)
    rng = np.random.default_rng(1)
    x, f = rng.uniform(0, 0.5, (90, 2)), rng.normal(size=(90, 5)) * 10
    f[:30] = f[0] + 1e-7 * rng.normal(size=(30, 5))
    f[30:35] = f[30]
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    more = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(f)], "id long, x array<double>")
    d, df = (np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) for v in (x, f))
    want = {(i, j): d[i, j] * df[i, j] for i, j in np.argwhere((d <= 0.2) & (df > 0)).tolist() if i != j}
    for cell in (4096, 7):
        monkeypatch.setattr(weights, "CELL", cell)
        got = weights.epsilon_ball(p, 0.2, "distance", more, 1.0).collect()
        assert len(got) == len(want) and all(abs(r.w - want[r.src, r.dst]) <= 1e-9 * want[r.src, r.dst] for r in got)


def test_no_array_function_for_each_pair(spark):
    for name in ("eps_ball_gaussian", "eps_ball_features"):
        plan = __spark_entry__.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan and "lambda" not in plan


def test_rounding_is_round(spark):
    v = [0.00005, 0.00015, 1.00005, -0.00005, -2.00015, 0.12345, 1e17, -1e-9, 0.0, float("inf"), *np.random.default_rng(0).normal(size=500)]
    rows = spark.createDataFrame([(float(x),) for x in v], "w double").select(_rounded("w", 4).alias("a"), (F.round("w", 4) + 0.0).alias("b"))
    assert rows.where("not a <=> b").isEmpty()
