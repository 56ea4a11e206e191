"""Queries on graph calculus."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import calculus, fixpoint
from weftgraph.plans.base import D, E, P, T, graph, points, query, r6, training, values

U = "u AS (SELECT id, x[1] AS u FROM p)"


@query(f"WITH {D} SELECT id, round(pow(d, 0.5), 6) + 0.0 AS d FROM d")
def degree_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculus.degree_power(*graph(spark, sf_dir), 0.5).select("id", r6("d").alias("d"))


@query(f"WITH {E} SELECT src, dst, 1.0::DOUBLE AS w FROM e")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculus.adjacency(graph(spark, sf_dir)[1])


@query(f"WITH {E}, k AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM p WHERE label < 5) SELECT a.n AS src, b.n AS dst, round(w, 6) + 0.0 AS w FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subgraph of half the classes, relabelled."""
    nodes, edges = graph(spark, sf_dir)
    return calculus.subgraph(nodes, edges, points(spark, sf_dir).where("label < 5").select("id"), relabel=True)[1].select("src", "dst", r6("w").alias("w"))


@query(f"WITH {E} SELECT dst AS id, round(w, 6) + 0.0 AS w FROM e WHERE src = (SELECT min(id) FROM p)")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return calculus.neighbors(edges, nodes.agg(F.min("id")).first()[0], weights=True).select("id", r6("w").alias("w"))


LAP_SQL = {
    "combinatorial": (D, "SELECT id AS src, id AS dst, d AS w FROM d UNION ALL SELECT src, dst, -w FROM e"),
    "randomwalk": (D, "SELECT id AS src, id AS dst, 1.0 AS w FROM d UNION ALL SELECT src, dst, -w / d FROM e JOIN d ON d.id = e.src"),
    "normalized": (D, "SELECT id AS src, id AS dst, 1.0 AS w FROM d UNION ALL SELECT e.src, e.dst, -w * pow(a.d, -0.5) * pow(b.d, -0.5) FROM e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst"),
    "coifmanlafon": (f"{D}, ea AS (SELECT e.src, e.dst, w / a.d / b.d AS w FROM e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst), da AS (SELECT src AS id, sum(w) AS d FROM ea GROUP BY src)", "SELECT id AS src, id AS dst, 1.0 AS w FROM p UNION ALL SELECT src, dst, -w / d FROM ea JOIN da ON da.id = ea.src"),
}


def _laplacian(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculus.laplacian(*graph(spark, sf_dir), kind).select("src", "dst", r6("w").alias("w"))


for _kind, (_with, _sql) in LAP_SQL.items():
    query(f"WITH {_with} SELECT src, dst, round(w, 6) + 0.0 AS w FROM ({_sql}) l", f"lap_{_kind}")(partial(_laplacian, _kind))


@query(f"WITH {E}, {U} SELECT src, dst, round(b.u - a.u, 6) + 0.0 AS v FROM e JOIN u a ON a.id = src JOIN u b ON b.id = dst")
def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculus.gradient(graph(spark, sf_dir)[1], values(spark, sf_dir)).select("src", "dst", r6("v").alias("v"))


@query(f"WITH {E}, {U} SELECT src, dst, round(sqrt(w) * (b.u - a.u), 6) + 0.0 AS v FROM e JOIN u a ON a.id = src JOIN u b ON b.id = dst")
def gradient_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculus.gradient(graph(spark, sf_dir)[1], values(spark, sf_dir), p=0.5).select("src", "dst", r6("v").alias("v"))


@query(f"WITH {E}, {U}, f AS (SELECT src, dst, (b.u - a.u) * (1 + a.u) AS v FROM e JOIN u a ON a.id = src JOIN u b ON b.id = dst) SELECT p.id, round(coalesce(sum(e.w * (f.v - coalesce(g.v, 0))), 0) / 2, 6) + 0.0 AS u FROM p LEFT JOIN f ON f.src = p.id LEFT JOIN f g ON g.src = f.dst AND g.dst = f.src LEFT JOIN e ON e.src = f.src AND e.dst = f.dst GROUP BY p.id")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    u = values(spark, sf_dir)
    field = calculus.gradient(edges, u).join(u.select(F.col("id").alias("src"), "u"), "src").select("src", "dst", (F.col("v") * (1 + F.col("u"))).alias("v"))
    return calculus.divergence(nodes, edges, field).select("id", r6("u").alias("u"))


@query(f"WITH {E}, {U} SELECT a.id, round(least(min(w * (b.u - a.u)), 0) + greatest(max(w * (b.u - a.u)), 0), 6) + 0.0 AS u FROM e JOIN u a ON a.id = src JOIN u b ON b.id = dst GROUP BY a.id")
def infinity_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return calculus.infinity_laplacian(nodes, edges, values(spark, sf_dir)).select("id", r6("u").alias("u"))


@query(f"WITH {E}, {T}, a AS (SELECT p.id, CASE WHEN t.id IS NULL THEN 1.0 ELSE (SELECT count(*) FROM p) / (SELECT count(*) FROM t)::DOUBLE END AS a FROM p LEFT JOIN t ON t.id = p.id) SELECT src, dst, round((s.a + d.a) * w, 6) + 0.0 AS w FROM e JOIN a s ON s.id = src JOIN a d ON d.id = dst")
def reweight_wnll(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return calculus.reweight_wnll(nodes, edges, training(spark, sf_dir)).select("src", "dst", r6("w").alias("w"))


@query(f"WITH {E}, {T}, m AS (SELECT a.id, min(list_distance(a.x, b.x)) AS d FROM p a, p b WHERE b.id IN (SELECT id FROM t) GROUP BY a.id), g AS (SELECT id, 1 + pow(0.1 / greatest(d, 0.1 / pow(1e7 - 1, 0.5)), 2.0) AS g FROM m) SELECT src, dst, round((s.g + d.g) * w, 4) + 0.0 AS w FROM e JOIN g s ON s.id = src JOIN g d ON d.id = dst")
def reweight_properly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculus.reweight_properly(points(spark, sf_dir).select("id", "x"), graph(spark, sf_dir)[1], training(spark, sf_dir)).select("src", "dst", r6("w", 4).alias("w"))


CLOSE = f"{P}, nn AS (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM p a JOIN p b ON a.id <> b.id QUALIFY r <= 1), b AS (SELECT src, dst FROM nn UNION SELECT dst, src FROM nn)"
CC = f"WITH RECURSIVE {CLOSE}, it(k, id, c) AS (SELECT 0, id, id FROM p UNION ALL SELECT k + 1, v, min(c) FROM (SELECT it.k, it.c, x.v FROM it JOIN (SELECT src AS u, dst AS v FROM b UNION ALL SELECT id, id FROM p) x ON x.u = it.id) WHERE k < 40 GROUP BY k, v), cc AS (SELECT id, c AS component FROM it WHERE k = 40)"


def nearest_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph of nearest neighbours only, which falls into many components."""
    from weftgraph.operators.knn import knn

    p = points(spark, sf_dir).select("id", "x")
    return p.select("id"), fixpoint.cut(knn(p, 1, method="exact").select("src", "dst", F.lit(1.0).alias("w")))


@query(f"{CC} SELECT id, component FROM cc")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = nearest_graph(spark, sf_dir)
    found = fixpoint.component_labels(edges)
    return nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query(f"{CC}, s AS (SELECT component, count(*) AS n FROM cc GROUP BY component ORDER BY n DESC, component LIMIT 1) SELECT id FROM cc JOIN s USING (component)")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixpoint.largest_component(*nearest_graph(spark, sf_dir))[0].select("id")


@query(f"{CC} SELECT count(DISTINCT component) = 1 AS connected FROM cc")
def isconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).agg((F.count_distinct("component") == 1).alias("connected"))


def _random(k: int) -> str:
    return f"((('0x' || substr(md5(src || ':' || dst || ':3:{k}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


@query(f"WITH {E} SELECT src, dst, round(sqrt(-2 * ln({_random(1)})) * cos(2 * pi() * {_random(2)}), 6) + 0.0 AS w FROM e")
def random_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculus.random_weights(graph(spark, sf_dir)[1], "normal", 3).select("src", "dst", r6("w").alias("w"))
