"""Queries on graph construction."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import weights
from weftgraph.operators.calculus import degrees
from weftgraph.operators.knn import knn
from weftgraph.plans.base import E0, NN, OWN, K, P, neighbours, plane, points, query, r6, table

DISTANCE_SQL = {
    "euclidean": "list_distance(a.x, b.x)",
    "angular": "list_distance(list_transform(a.x, lambda v: v / sqrt(list_inner_product(a.x, a.x))), list_transform(b.x, lambda v: v / sqrt(list_inner_product(b.x, b.x))))",
    "manhattan": "list_sum(list_transform(list_zip(a.x, b.x), lambda v: abs(v[1] - v[2])))",
    "hamming": "list_sum(list_transform(list_zip(a.x, b.x), lambda v: CASE WHEN round(v[1] * 4) <> round(v[2] * 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))",
    "dot": "list_inner_product(a.x, b.x)",
}


def _knn(similarity: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    if similarity == "hamming":  # of the coordinates as small integers
        rounded = points(spark, sf_dir).select("id", F.transform("x", lambda v: F.round(v * 4)).alias("x"))
        found = knn(rounded, K, "hamming", method="exact")
    else:
        found = neighbours(spark, sf_dir, similarity)
    return found.select("src", "dst", "rank", r6("dist").alias("dist"))


for _name, _sql in DISTANCE_SQL.items():
    _order = "DESC" if _name == "dot" else "ASC"
    query(f"WITH {P}, pr AS (SELECT a.id AS src, b.id AS dst, {_sql} AS dist FROM p a JOIN p b ON a.id <> b.id) SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dist {_order}, dst)::INTEGER AS rank, round(dist, 6) + 0.0 AS dist FROM pr QUALIFY rank <= {K}", f"knn_{_name}")(partial(_knn, _name))

WEIGHT_SQL = {
    "uniform": ("1.0::DOUBLE", "max"),
    "gaussian": ("exp(-4 * dist * dist / (own * own))", "mean"),
    "symgaussian": ("exp(-4 * dist * dist / (own * other))", "max"),
    "distance": ("dist", "max"),
    "singular": ("CASE WHEN dist = 0 THEN 1.0 ELSE 1 / dist END", "max"),
}


def _weights(kernel: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.knn_weights(neighbours(spark, sf_dir), kernel).select("src", "dst", r6("w").alias("w"))


for _name, (_sql, _how) in WEIGHT_SQL.items():
    _agg = "max(w)" if _how == "max" else "sum(w) / 2"
    query(f"WITH {OWN}, q AS (SELECT nb.*, o.own AS other FROM nb JOIN (SELECT src, max(dist) AS own FROM nn GROUP BY src) o ON o.src = nb.dst), e0 AS (SELECT src, dst, {_sql} AS w FROM q), e AS (SELECT src, dst, {_agg} AS w FROM (SELECT * FROM e0 UNION ALL SELECT dst, src, w FROM e0) GROUP BY src, dst) SELECT src, dst, round(w, 6) + 0.0 AS w FROM e WHERE src <> dst AND w <> 0", f"knn_{_name}_w")(partial(_weights, _name))


@query(f"WITH {OWN}, e0 AS (SELECT src, dst, 1 / (1 + dist * dist / (own * own)) AS w FROM nb) SELECT src, dst, round(sum(w) / 2, 6) + 0.0 AS w FROM (SELECT * FROM e0 UNION ALL SELECT dst, src, w FROM e0) GROUP BY src, dst")
def knn_custom_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel of the caller's own."""
    return weights.knn_weights(neighbours(spark, sf_dir), lambda s: 1 / (1 + s)).select("src", "dst", r6("w").alias("w"))


@query(f"WITH {E0} SELECT src, dst, round(w, 6) + 0.0 AS w FROM e0")
def knn_directed_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.knn_weights(neighbours(spark, sf_dir), "gaussian", symmetric=False).select("src", "dst", r6("w").alias("w"))


EPS = 0.05
PLANE = "q AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding::DOUBLE[] AS f FROM embeddings)"
PAIRS = f"WITH {PLANE}, b AS (SELECT a.id AS src, c.id AS dst, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) AS dist, list_distance(a.f, c.f) AS fdist FROM q a JOIN q c ON a.id <> c.id)"
BALL_SQL = {"uniform": "1.0::DOUBLE", "gaussian": f"exp(-4 * dist * dist / ({EPS} * {EPS}))", "distance": "dist", "singular": "CASE WHEN dist = 0 THEN 1.0 ELSE 1 / dist END"}


def _rounded(c: str, digits: int) -> Column:
    """As r6, for a great many rows: decimals only where a value may lie half way, or has many digits."""
    scaled = F.col(c) * 10.0**digits
    sure = (F.abs(scaled) < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(sure, F.floor(scaled + 0.5) / 10.0**digits).otherwise(F.round(c, digits)) + 0.0


def _ball(kernel: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.epsilon_ball(plane(spark, sf_dir), EPS, kernel).select("src", "dst", _rounded("w", 4).alias("w"))


for _name, _sql in BALL_SQL.items():
    query(f"{PAIRS} SELECT src, dst, round({_sql}, 4) + 0.0 AS w FROM b WHERE dist <= {EPS}", f"eps_ball_{_name}")(partial(_ball, _name))


@query(f"{PAIRS} SELECT src, dst, round(exp(-4 * dist * dist / ({EPS} * {EPS})) * exp(-4 * fdist * fdist / 4.0), 6) + 0.0 AS w FROM b WHERE dist <= {EPS}")
def eps_ball_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.epsilon_ball(plane(spark, sf_dir), EPS, "gaussian", points(spark, sf_dir).select("id", "x"), 2.0).select("src", "dst", _rounded("w", 6).alias("w"))


@query("WITH g AS (SELECT r * 30 + c AS id, r, c FROM range(20) a(r), range(30) b(c)) SELECT a.id AS src, b.id AS dst, 1.0::DOUBLE AS w FROM g a JOIN g b ON abs(a.r - b.r) + abs(a.c - b.c) = 1")
def grid_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.grid_graph(spark, 20, 30)


@query("SELECT l_partkey AS part, l_suppkey AS supplier, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2")
def bipartite_parts_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted bipartite graph of a fact table: how often a supplier delivered a part."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.count("*").cast("double").alias("w"))


@query(f"WITH {NN} SELECT src, dst, max(w)::DOUBLE AS w FROM (SELECT src, dst, 1.0 AS w FROM nn UNION ALL SELECT dst, src, 2.0 FROM nn) GROUP BY src, dst")
def sparse_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = neighbours(spark, sf_dir).select("src", "dst", F.lit(1.0).alias("w"))
    return weights.sparse_max(a, weights.reverse(a).withColumn("w", F.lit(2.0)))


@query(f"WITH {E0}, e AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT * FROM e0 UNION ALL SELECT dst, src, w FROM e0) GROUP BY src, dst) SELECT p.id, round(coalesce(sum(w), 0), 6) + 0.0 AS d FROM p LEFT JOIN e ON p.id = e.src GROUP BY p.id")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings -> exact neighbours -> Gaussian kernel -> symmetric graph -> weighted degree."""
    nodes, edges = points(spark, sf_dir).select("id"), weights.knn_weights(neighbours(spark, sf_dir))
    return degrees(nodes, edges).select("id", r6("d").alias("d"))


@query()
def knn_forest_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph by the approximate search."""
    return weights.knn_graph(points(spark, sf_dir).select("id", "x"), K, method="forest")


@query(f"WITH {P} SELECT id, label FROM p")
def load_labels_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", "label")

