"""Queries that run a fixed number of rounds, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import linear, nonlinear, paths, ssl
from weftgraph.operators.calculus import laplacian
from weftgraph.plans.base import D, E, T, graph, query, r6, training

ROUNDS = 6
#: Edges of the recursive term: the graph's own and, for monotone rounds, a loop that keeps a value.
LOOPED = f"{E}, lp AS (SELECT src, dst, w FROM e UNION ALL SELECT id, id, NULL FROM p)"
START = "(SELECT min(id) FROM p)"


@query(f"WITH RECURSIVE {D}, n AS (SELECT count(*) AS n FROM p), it(k, id, u) AS (SELECT 0, id, 1.0 / n FROM p, n UNION ALL SELECT k + 1, dst, 0.85 * sum(w / d * u) + 0.15 / any_value(n) FROM it JOIN e ON e.src = it.id JOIN d ON d.id = it.id, n WHERE k < {ROUNDS} GROUP BY k, dst) SELECT id, round(u, 8) + 0.0 AS u FROM it WHERE k = {ROUNDS}")
def pagerank_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.page_rank(*graph(spark, sf_dir), rounds=ROUNDS).select("id", r6("u", 8).alias("u"))


def _source(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("id").alias("id")).withColumn("g", F.lit(0.0))


SHORT = "SELECT k + 1, dst, min(CASE WHEN w IS NULL THEN d ELSE {step} END) FROM it JOIN lp ON lp.src = it.id WHERE k < {rounds} GROUP BY k, dst"


@query(f"WITH RECURSIVE {LOOPED}, it(k, id, d) AS (SELECT 0, {START}, 0.0::DOUBLE UNION ALL {SHORT.format(step='d + 1 / w', rounds=ROUNDS)}) SELECT id, round(d, 6) + 0.0 AS d FROM it WHERE k = {ROUNDS}")
def dijkstra_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return paths.dijkstra(nodes, edges, _source(nodes), reciprocal=True, rounds=ROUNDS).where("d < double('infinity')").select("id", r6("d").alias("d"))


@query(f"WITH RECURSIVE {LOOPED}, {T}, it(k, id, b) AS (SELECT 0, id, {{'d': 0.0::DOUBLE, 'cp': id}} FROM t UNION ALL SELECT k + 1, dst, min(CASE WHEN w IS NULL THEN b ELSE {{'d': b.d + 1 / w, 'cp': b.cp}} END) FROM it JOIN lp ON lp.src = it.id WHERE k < {ROUNDS} GROUP BY k, dst) SELECT id, round(b.d, 6) + 0.0 AS d, b.cp AS cp FROM it WHERE k = {ROUNDS}")
def dijkstra_closest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    start = training(spark, sf_dir).select("id", F.lit(0.0).alias("g"))
    return paths.dijkstra(nodes, edges, start, reciprocal=True, rounds=ROUNDS).where("cp is not null").select("id", r6("d").alias("d"), "cp")


@query(f"WITH RECURSIVE {LOOPED}, it(k, id, d) AS (SELECT 0, {START}, 0.0::DOUBLE UNION ALL {SHORT.format(step='(w + sqrt(w * w + 4 * d * d)) / 2', rounds=ROUNDS)}) SELECT id, round(d, 6) + 0.0 AS d FROM it WHERE k = {ROUNDS}")
def dijkstra_hopf_lax_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return paths.dijkstra_hl(nodes, edges, _source(nodes), rounds=ROUNDS).where("d < double('infinity')").select("id", r6("d").alias("d"))


@query(f"WITH RECURSIVE {LOOPED}, {T}, it(k, s, id, d) AS (SELECT 0, id, id, 0.0::DOUBLE FROM t UNION ALL SELECT k + 1, s, dst, min(CASE WHEN w IS NULL THEN d ELSE d + 1 / w END) FROM it JOIN lp ON lp.src = it.id WHERE k < {ROUNDS} GROUP BY k, s, dst) SELECT s AS source, id, round(d, 6) + 0.0 AS d FROM it WHERE k = {ROUNDS}")
def distance_matrix_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from the labelled nodes."""
    nodes, edges = graph(spark, sf_dir)
    return paths.distance_matrix(nodes, edges, rounds=ROUNDS, sources=training(spark, sf_dir).select("id")).select("source", "id", r6("d").alias("d"))


@query(f"WITH RECURSIVE {D}, {T}, c AS (SELECT DISTINCT label AS cls FROM t), b AS (SELECT p.id, cls, coalesce(CASE WHEN t.id IS NULL THEN 0.0 ELSE (CASE WHEN t.label = cls THEN 1.0 ELSE 0.0 END) - (SELECT count(*) FROM t z WHERE z.label = cls) / (SELECT count(*) FROM t)::DOUBLE END, 0)::DOUBLE AS s FROM p JOIN c ON true LEFT JOIN t ON t.id = p.id), it(k, id, cls, u) AS (SELECT 0, id, cls, 0.0::DOUBLE FROM b UNION ALL SELECT k + 1, e.dst, it.cls, (any_value(b.s) + sum(w * u)) / any_value(d.d) FROM it JOIN e ON e.src = it.id JOIN b ON b.id = e.dst AND b.cls = it.cls JOIN d ON d.id = e.dst WHERE k < {ROUNDS} GROUP BY k, e.dst, it.cls) SELECT id, cls::INTEGER AS cls, round(u, 6) + 0.0 AS u FROM it WHERE k = {ROUNDS}")
def poisson_gd_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return ssl.poisson_descent(nodes, edges, training(spark, sf_dir), 10, ROUNDS).select("id", "cls", r6("u").alias("u"))


def _boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 at the labelled nodes of class 0 and 0 at the others'."""
    return training(spark, sf_dir).select("id", F.when(F.col("label") == 0, 1.0).otherwise(0.0).alias("g"))


def _sweeps(value: str, start: str = "(SELECT min(g) FROM g)") -> str:
    return f"WITH RECURSIVE {E}, {T}, g AS (SELECT id, CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS g FROM t), b AS (SELECT p.id, g.g, coalesce(g.g, {start})::DOUBLE AS u0 FROM p LEFT JOIN g ON g.id = p.id), it(k, id, u) AS (SELECT 0, id, u0 FROM b UNION ALL SELECT k + 1, src, coalesce(any_value(g), {value}) FROM (SELECT it.k, e.src, e.w, it.u AS uj, b.g FROM it JOIN e ON e.dst = it.id JOIN b ON b.id = e.src) WHERE k < {ROUNDS} GROUP BY k, src) SELECT id, round(u, 6) + 0.0 AS u FROM it WHERE k = {ROUNDS}"


@query(_sweeps("sum(w * uj) / sum(w)"))
def laplace_jacobi_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonic sweeps: the p-Laplace equation for p = 2."""
    return nonlinear.plaplace(*graph(spark, sf_dir), _boundary(spark, sf_dir), 2.0, rounds=ROUNDS).select("id", r6("u").alias("u"))


@query(_sweeps("0.25 * sum(w * uj) / sum(w) + 0.75 * (min(uj) + max(uj)) / 2"))
def plaplace_fast_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nonlinear.plaplace(*graph(spark, sf_dir), _boundary(spark, sf_dir), 5.0, rounds=ROUNDS).select("id", r6("u").alias("u"))


@query(
    f"WITH RECURSIVE {E}, {T}, g AS (SELECT id, CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS g FROM t), b AS (SELECT p.id, g.g FROM p LEFT JOIN g ON g.id = p.id), dt AS (SELECT 0.9 / (0.2 + 2 * 0.6) / max(w) AS dt FROM e), x AS (SELECT src, dst, w FROM e UNION ALL SELECT id, id, NULL FROM p), "
    f"it(k, side, id, u) AS (SELECT 0, side, id, coalesce(g, side)::DOUBLE FROM b, (VALUES (0), (1)) s(side) UNION ALL "
    "SELECT k + 1, side, src, coalesce(g, own + dt * (ss / (5 * sw) + 0.6 * (least(slo, 0) + greatest(shi, 0)))) FROM ("
    "SELECT k, side, src, any_value(g) AS g, max(own) AS own, any_value(dt) AS dt, sum(w * (uj - mine)) AS ss, sum(w) AS sw, min(w * (uj - mine)) AS slo, max(w * (uj - mine)) AS shi FROM ("
    "SELECT it.k, it.side, x.src, x.w, it.u AS uj, b.g, dt.dt, CASE WHEN x.w IS NULL THEN it.u END AS own, max(CASE WHEN x.w IS NULL THEN it.u END) OVER (PARTITION BY it.k, it.side, x.src) AS mine FROM it JOIN x ON x.dst = it.id JOIN b ON b.id = x.src, dt) GROUP BY k, side, src) "
    f"WHERE k < {ROUNDS}) SELECT id, round(sum(u) / 2, 6) + 0.0 AS u FROM it WHERE k = {ROUNDS} GROUP BY id"
)
def plaplace_slow_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper and lower solutions of the weighted operator, and their mean."""
    return nonlinear.plaplace(*graph(spark, sf_dir), _boundary(spark, sf_dir), 5.0, fast=False, rounds=ROUNDS).select("id", r6("u").alias("u"))


@query(_sweeps("(min(uj) + max(uj)) / 2"))
def amle_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nonlinear.amle(*graph(spark, sf_dir), _boundary(spark, sf_dir), rounds=ROUNDS).select("id", r6("u").alias("u"))


@query(
    f"WITH RECURSIVE {E}, g AS (SELECT min(id) AS id, 0.0::DOUBLE AS g FROM p), x AS (SELECT src, dst, w FROM e UNION ALL SELECT id, id, NULL FROM g), it(k, id, u) AS (SELECT 0, id, g FROM g UNION ALL "
    "SELECT k + 1, id, u FROM (SELECT k, src AS id, CASE WHEN src = (SELECT id FROM g) THEN 0.0 ELSE min((1 + s) / sw) END AS u FROM ("
    "SELECT it.k, x.src, sum(x.w * it.u) OVER o AS s, sum(x.w) OVER o AS sw FROM it JOIN x ON x.dst = it.id WINDOW o AS (PARTITION BY it.k, x.src ORDER BY it.u ROWS UNBOUNDED PRECEDING)) GROUP BY k, src) z "
    "WHERE k < 4) SELECT id, round(u, 6) + 0.0 AS u FROM it WHERE k = 4"
)
def eikonal_p1_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of the p-eikonal equation for p = 1 from one node: the least of (f + sum w u) / sum w over prefixes of the sorted neighbours."""
    nodes, edges = graph(spark, sf_dir)
    return nonlinear.peikonal_p1(nodes, edges, _source(nodes), rounds=4).where("u < double('infinity')").select("id", r6("u").alias("u"))


@query(f"WITH {E}, {T}, g AS (SELECT id, 0.0::DOUBLE AS g FROM t) SELECT id, g FROM g UNION ALL SELECT src AS id, avg(g) AS g FROM e JOIN g ON g.id = e.dst WHERE src NOT IN (SELECT id FROM t) GROUP BY src")
def dilate_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return nonlinear.dilate_boundary(nodes, edges, training(spark, sf_dir).select("id", F.lit(0.0).alias("g")))


@query(f"WITH RECURSIVE {LOOPED}, {T}, it(k, id, b) AS (SELECT 0, id, {{'d': 0.0::DOUBLE, 'cp': id}} FROM t UNION ALL SELECT k + 1, dst, min(CASE WHEN w IS NULL THEN b ELSE {{'d': b.d + w, 'cp': b.cp}} END) FROM it JOIN lp ON lp.src = it.id WHERE k < 40 GROUP BY k, dst) SELECT it.id, t.label::INTEGER AS label FROM it JOIN t ON t.id = it.b.cp WHERE k = 40")
def graph_nn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of the nearest labelled node, to convergence."""
    model = ssl.GraphNearestNeighbor(ssl.Graph(*graph(spark, sf_dir)))
    return model.nearest(training(spark, sf_dir)).select("id", "label")


@query(f"WITH RECURSIVE {D}, {T}, c AS (SELECT DISTINCT label AS cls FROM t), y AS (SELECT p.id, cls, CASE WHEN t.label = cls THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM p JOIN c ON true LEFT JOIN t ON t.id = p.id), it(k, id, cls, u) AS (SELECT 0, id, cls, y FROM y UNION ALL SELECT k + 1, e.src, it.cls, any_value(y.y) + 0.95 * sum(w / sqrt(a.d) / sqrt(b.d) * u) FROM it JOIN e ON e.dst = it.id JOIN y ON y.id = e.src AND y.cls = it.cls JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst WHERE k < 400 GROUP BY k, e.src, it.cls) SELECT id, cls::INTEGER AS cls, round(u, 3) + 0.0 AS u FROM it WHERE k = 400")
def randomwalk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """((1 - a) I + a L) u = y by conjugate gradients; in SQL its Neumann series, run until it has converged."""
    model = ssl.RandomWalk(ssl.Graph(*graph(spark, sf_dir)), tol=1e-9)
    return model.fit(training(spark, sf_dir)).select("id", "cls", r6("u", 3).alias("u"))


@query(f"WITH RECURSIVE {LOOPED}, {T}, it(k, id, d) AS (SELECT 0, {START}, 0.0::DOUBLE UNION ALL {SHORT.format(step='d + 1 / w', rounds=40)}) SELECT {START} AS src, id AS dst, round(d, 6) + 0.0 AS d FROM it WHERE k = 40 AND id = (SELECT max(id) FROM p)")
def distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of the first and the last node, to convergence."""
    nodes, edges = graph(spark, sf_dir)
    first, last = nodes.agg(F.min("id"), F.max("id")).first()
    d = paths.distance(nodes, edges, first, last)
    return spark.createDataFrame([(first, last, float(d))], "src long, dst long, d double").select("src", "dst", r6("d").alias("d"))


#: Classes, their boundary values, and sweeps of all classes' problems until they have converged.
def _all_classes(value: str, rounds: int, edges: str = "e", digits: int = 3, start: str = "0.0") -> str:
    return (
        f"c AS (SELECT DISTINCT label AS cls FROM t), b AS (SELECT p.id, cls, CASE WHEN t.id IS NULL THEN NULL WHEN t.label = cls THEN 1.0 ELSE 0.0 END::DOUBLE AS g FROM p JOIN c ON true LEFT JOIN t ON t.id = p.id), "
        f"it(k, id, cls, u) AS (SELECT 0, id, cls, coalesce(g, {start})::DOUBLE FROM b UNION ALL SELECT k + 1, src, cls, coalesce(any_value(g), {value}) FROM (SELECT it.k, x.src, x.w, it.cls, it.u AS uj, b.g FROM it JOIN {edges} x ON x.dst = it.id JOIN b ON b.id = x.src AND b.cls = it.cls) WHERE k < {rounds} GROUP BY k, src, cls) "
        f"SELECT id, cls::INTEGER AS cls, round(u, {digits}) + 0.0 AS u FROM it WHERE k = {rounds}"
    )


def _solved(name: str, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Class scores of a model solved to a tolerance far below what is compared."""
    return ssl.MODELS[name](ssl.Graph(*graph(spark, sf_dir)), **options).fit(training(spark, sf_dir)).select("id", "cls", r6("u", 3).alias("u"))


@query(f"WITH RECURSIVE {E}, {T}, {_all_classes('sum(w * uj) / sum(w)', 400)}")
def laplace_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harmonic extension by conjugate gradients; in SQL by sweeps."""
    return _solved("laplace", spark, sf_dir, tol=1e-9)


WNLL = "a AS (SELECT p.id, CASE WHEN t.id IS NULL THEN 1.0 ELSE (SELECT count(*) FROM p) / (SELECT count(*) FROM t)::DOUBLE END AS a FROM p LEFT JOIN t ON t.id = p.id), ew AS (SELECT src, dst, (i.a + j.a) * w AS w FROM e JOIN a i ON i.id = src JOIN a j ON j.id = dst)"


@query(f"WITH RECURSIVE {E}, {T}, {WNLL}, {_all_classes('sum(w * uj) / sum(w)', 400, 'ew')}")
def laplace_wnll_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved("laplace", spark, sf_dir, reweighting="wnll", tol=1e-9)


@query(f"WITH RECURSIVE {E}, {T}, {_all_classes('(min(uj) + max(uj)) / 2', 400)}".replace("round(u, 3)", "round(u + 1e-6, 3)"))
def amle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are often fractions of few binary digits: a little is added so that they don't lie at the edge of rounding."""
    nodes, edges = graph(spark, sf_dir)
    return ssl.AMLE(ssl.Graph(nodes, edges), tol=1e-10).fit(training(spark, sf_dir)).select("id", "cls", r6(F.col("u") + 1e-6, 3).alias("u"))


@query(f"WITH RECURSIVE {E}, {T}, {_all_classes('sum(w * uj) / sum(w) / 9 + 4 * (min(uj) + max(uj)) / 9', 400)}")
def plaplace_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved("plaplace", spark, sf_dir, p=10.0, tol=1e-10)


@query(f"WITH RECURSIVE {E}, {T}, b AS (SELECT p.id, t.label::DOUBLE AS g FROM p LEFT JOIN t ON t.id = p.id), it(k, id, u) AS (SELECT 0, id, coalesce(g, 0) FROM b UNION ALL SELECT k + 1, src, coalesce(any_value(g), sum(w * uj) / sum(w)) FROM (SELECT it.k, e.src, e.w, it.u AS uj, b.g FROM it JOIN e ON e.dst = it.id JOIN b ON b.id = e.src) WHERE k < 400 GROUP BY k, src) SELECT id, round(u, 3) + 0.0 AS u FROM it WHERE k = 400")
def constrained_gmres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the neighbours off the labelled nodes, the labels there, by GMRES; in SQL by sweeps."""
    nodes, edges = graph(spark, sf_dir)
    eye = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    bdy = training(spark, sf_dir).select("id", F.col("label").cast("double").alias("g"))
    return linear.constrained_solve_gmres(nodes, laplacian(nodes, edges, "randomwalk"), None, eye, bdy, 1e-9).select("id", r6("u", 3).alias("u"))


def _propagation(rounds: int) -> str:
    """Rounds of the primal-dual scheme, each two tables: values (with those before), and duals of the edges."""
    out = [f"{D}, {T}, c AS (SELECT DISTINCT label AS cls FROM t), b AS (SELECT p.id, cls, 1 / d.d AS tau, CASE WHEN t.id IS NULL THEN NULL WHEN t.label = cls THEN 1.0 ELSE 0.0 END::DOUBLE AS g FROM p JOIN c ON true JOIN d ON d.id = p.id LEFT JOIN t ON t.id = p.id), u0 AS (SELECT id, cls, 0.0::DOUBLE AS u FROM b), y0 AS (SELECT src, dst, w, cls, 0.0::DOUBLE AS y FROM e, c)"]
    for k in range(1, rounds + 1):
        out.append(f"u{k} AS (SELECT b.id, b.cls, coalesce(g, u0.u - 2 * tau * s) AS u, 2 * coalesce(g, u0.u - 2 * tau * s) - u0.u AS ahead FROM b JOIN u{k - 1} u0 ON u0.id = b.id AND u0.cls = b.cls JOIN (SELECT src, cls, sum(w * y) AS s FROM y{k - 1} GROUP BY src, cls) z ON z.src = b.id AND z.cls = b.cls)")
        out.append(f"y{k} AS (SELECT y.src, y.dst, y.w, y.cls, greatest(-1, least(1, y.y - (j.ahead - i.ahead) / 2)) AS y FROM y{k - 1} y JOIN u{k} i ON i.id = y.src AND i.cls = y.cls JOIN u{k} j ON j.id = y.dst AND j.cls = y.cls)")
    return f"WITH {', '.join(out)} SELECT id, cls::INTEGER AS cls, round(u, 6) + 0.0 AS u FROM u{rounds}"


@query(_propagation(ROUNDS))
def sparse_propagation_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of sparse label propagation as joins."""
    cols = [f"u{c}" for c in range(10)]
    wide = ssl.sparse_propagation(*graph(spark, sf_dir), training(spark, sf_dir), cols, ROUNDS)
    return ssl.wide_to_long(wide, cols).select("id", "cls", r6("u").alias("u"))
