"""Queries on solvers that run to a tolerance, random starts and eigenvectors: beyond SQL, checked by invariants in the tests."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import blocks, cluster, embed, geometry, linear, nonlinear, ssl
from weftgraph.operators.calculus import laplacian
from weftgraph.operators.fixpoint import cut
from weftgraph.plans import iteration  # noqa: F401  its SQL is used here
from weftgraph.plans.base import P, SQL, D, T, graph, plane, points, query, r6, training


def _model(name: str, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Labels by a classifier from the stratified training set."""
    nodes, edges = graph(spark, sf_dir)
    g = ssl.Graph(nodes, edges, points(spark, sf_dir).select("id", "x"))
    if name in ("volume_mbo", "poisson_mbo"):
        options["priors"] = [r.prior for r in ssl.class_priors(points(spark, sf_dir)).orderBy("cls").collect()]
    if name == "volume_mbo":
        options["plan"] = "blocks"
    return ssl.MODELS[name](g, **options).fit_predict(training(spark, sf_dir))


#: Two rounds of dynamic label propagation: u1 = P u0, u2 = P (P (P^T u1)) + 0.05 V (V^T u1) + 0.1 u1, V being P u0; labels held.
DYNAMIC = (
    f"WITH {D}, {T}, wk AS (SELECT src, dst, w / d AS w FROM e JOIN d ON d.id = src), u0 AS (SELECT p.id, c, CASE WHEN t.label = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS u, t.id IS NOT NULL AS held FROM p CROSS JOIN (SELECT unnest(range(max(label) + 1)) AS c FROM t) k LEFT JOIN t ON t.id = p.id), "
    "v AS (SELECT src AS id, c, sum(w * u) AS u FROM wk JOIN u0 ON u0.id = dst GROUP BY src, c), u1 AS (SELECT u0.id, u0.c, CASE WHEN held THEN u0.u ELSE coalesce(v.u, 0) END AS u FROM u0 LEFT JOIN v ON v.id = u0.id AND v.c = u0.c), "
    "b1 AS (SELECT dst AS id, c, sum(w * u) AS u FROM wk JOIN u1 ON u1.id = src GROUP BY dst, c), b2 AS (SELECT src AS id, c, sum(w * u) AS u FROM wk JOIN b1 ON b1.id = dst GROUP BY src, c), b3 AS (SELECT src AS id, c, sum(w * u) AS u FROM wk JOIN b2 ON b2.id = dst GROUP BY src, c), "
    "m AS (SELECT v.c AS i, u1.c AS c, sum(v.u * u1.u) AS m FROM v JOIN u1 ON u1.id = v.id GROUP BY v.c, u1.c), low AS (SELECT v.id, m.c, sum(v.u * m.m) AS u FROM v JOIN m ON m.i = v.c GROUP BY v.id, m.c), "
    "u2 AS (SELECT u0.id, u0.c, CASE WHEN held THEN u0.u ELSE coalesce(b3.u, 0) + 0.05 * coalesce(low.u, 0) + 0.1 * u1.u END AS u FROM u0 JOIN u1 ON u1.id = u0.id AND u1.c = u0.c LEFT JOIN b3 ON b3.id = u0.id AND b3.c = u0.c LEFT JOIN low ON low.id = u0.id AND low.c = u0.c) "
)


@query(DYNAMIC + "SELECT id, c::INTEGER AS cls, round(u, 8) + 0.0 AS u FROM u2")
def dynamic_propagation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of dynamic label propagation through thin factors."""
    return ssl.DynamicLabelPropagation(ssl.Graph(*graph(spark, sf_dir))).fit(training(spark, sf_dir)).select("id", "cls", r6("u", 8).alias("u"))


MODEL_SQL = {"graph_nearest_neighbor": SQL["graph_nn_predict"], "dynamic_label_propagation": DYNAMIC + "SELECT id, arg_max(c, struct_pack(u := u, c := -c))::INTEGER AS label FROM u2 GROUP BY id"}
for _name in ssl.MODELS:
    query(MODEL_SQL.get(_name), f"ssl_{_name}")(partial(_model, _name))
for _how in ("poisson", "wnll", "properly"):
    query(name=f"ssl_laplace_{_how}")(partial(_model, "laplace", reweighting=_how))
query(name="ssl_poisson_spectral")(partial(_model, "poisson", solver="spectral"))
query(name="ssl_laplace_order2")(partial(_model, "laplace", order=2, tau=0.01))
query(name="ssl_amle_weighted")(partial(_model, "amle", weighted=True))


@query()
def conjgrad_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the random walk model by conjugate gradients as joins."""
    model = ssl.RandomWalk(ssl.Graph(*graph(spark, sf_dir)), plan="distributed", tol=1e-4)
    return model.fit(training(spark, sf_dir)).select("id", "cls", r6("u", 3).alias("u"))


@query()
def fiedler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.fiedler_vector(*graph(spark, sf_dir))


@query()
def eigen_lowrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.eigen_decomp(*graph(spark, sf_dir), 5, method="lowrank")[1]


def _left(found: tuple, nodes: DataFrame, a: DataFrame) -> DataFrame:
    """id, component, residual: what each vector leaves at each node of A v - value v (0 to six digits)."""
    vals, u = found
    r = blocks.residuals(nodes, a, vals, u)
    return r.select("id", F.posexplode(F.array(*r.columns[1:])).alias("component", "r")).select("id", F.col("component").cast("int").alias("component"), r6(F.abs("r")).alias("residual"))


LEFT = "SELECT p.id, c.c::INTEGER AS component, 0.0::DOUBLE AS residual FROM p, range({k}) c(c)"


@query()
def diffusion_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear.diffusion_map(*graph(spark, sf_dir), 3)


@query(f"WITH {P} {LEFT.format(k=5)}")
def eigen_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the five smallest eigenpairs of the normalized Laplacian hold at every node."""
    nodes, edges = graph(spark, sf_dir)
    a = cut(laplacian(nodes, edges, "normalized"))
    return _left(linear.eigen_decomp(nodes, edges, 5, "normalized", tol=1e-8), nodes, a)


@query()
def dirichlet_eigenvectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return linear.dirichlet_eigenvectors(nodes, laplacian(nodes, edges), training(spark, sf_dir).select("id"), 3)[1]


@query()
def peikonal_p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph(spark, sf_dir)
    return nonlinear.peikonal(nodes, edges, training(spark, sf_dir).select("id", F.lit(0.0).alias("g")), 2.0)


def _spectral(method: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.spectral(*graph(spark, sf_dir), 10, method)


for _name in ("combinatorial", "ShiMalik", "NgJordanWeiss"):
    query(name=f"spectral_{_name}")(partial(_spectral, _name))


@query()
def fokker_planck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.fokker_planck(*graph(spark, sf_dir), 10)


@query()
def incres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.incres(*graph(spark, sf_dir), 10)


@query()
def rp1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.rp1d(points(spark, sf_dir).select("id", "x"))


@query()
def tsne_ars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.ars(points(spark, sf_dir).select("id", "x"), rounds=100)


@query()
def pca_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.pca_features(points(spark, sf_dir).select("id", "x"), 5)


@query()
def draw_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.draw_coordinates(*graph(spark, sf_dir))


@query()
def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.mesh(plane(spark, sf_dir))
