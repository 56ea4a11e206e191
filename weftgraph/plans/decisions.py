"""Queries on decisions, scores, acquisition functions, and data."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import active, calculus, cluster, geometry, images, ssl, trials
from weftgraph.operators.fixpoint import cut
from weftgraph.plans.base import D, E, NN, P, T, graph, kept, points, query, r6, table, training
from weftgraph.sources import datasets


@query("SELECT label::INTEGER AS cls, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) + 0.0 AS prior FROM embeddings WHERE label >= 0 GROUP BY label")
def class_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssl.class_priors(points(spark, sf_dir)).select("cls", r6("prior").alias("prior"))


@query("SELECT vec_id AS id, cls::INTEGER AS cls, CASE WHEN label = cls THEN 1.0 ELSE 0.0 END::DOUBLE AS u FROM embeddings, (SELECT DISTINCT label AS cls FROM embeddings)")
def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssl.onehot(points(spark, sf_dir))


#: Class scores of a node: the shares of its weight that lead to neighbours of each class.
SCORES = f"{D}, c AS (SELECT DISTINCT label AS cls FROM p), sc AS (SELECT p.id, c.cls::INTEGER AS cls, coalesce(sum(CASE WHEN q.label = c.cls THEN w END), 0) / any_value(d.d) AS u FROM p JOIN c ON true JOIN d ON d.id = p.id JOIN e ON e.src = p.id JOIN p q ON q.id = e.dst GROUP BY p.id, c.cls)"


def scores(spark: SparkSession, sf_dir: str, made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    nodes, edges = made or graph(spark, sf_dir)
    hot = ssl.onehot(points(spark, sf_dir)).select(F.col("id").alias("dst"), "cls", "u")
    sums = edges.join(hot, "dst").groupBy(F.col("src").alias("id"), "cls").agg(F.sum(F.col("w") * F.col("u")).alias("s"))
    return cut(sums.join(calculus.degrees(nodes, edges), "id").select("id", "cls", (F.col("s") / F.col("d")).alias("u")))


PREDICTED = "pr AS (SELECT id, arg_max(cls, {'s': round(u, 12), 'c': -cls})::INTEGER AS label FROM sc GROUP BY id)"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssl.predict(scores(spark, sf_dir).withColumn("u", F.round("u", 12)))


@query(f"WITH {SCORES}, {PREDICTED} SELECT id, label FROM pr")
def predict_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted(spark, sf_dir)


@query(f"WITH {SCORES}, {PREDICTED}, {T} SELECT round(100 * avg(CASE WHEN pr.label = p.label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM pr JOIN p ON p.id = pr.id WHERE p.id NOT IN (SELECT id FROM t) AND p.label >= 0")
def ssl_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.accuracy(points(spark, sf_dir), predicted(spark, sf_dir), training(spark, sf_dir)).select(r6("accuracy").alias("accuracy"))


@query(f"WITH {SCORES}, {PREDICTED} SELECT pr.label AS cluster, p.label::INTEGER AS label, count(*) AS n FROM pr JOIN p ON p.id = pr.id GROUP BY 1, 2")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.confusion(points(spark, sf_dir), predicted(spark, sf_dir).withColumnRenamed("label", "cluster"))


@query(f"WITH {SCORES}, {PREDICTED}, m AS (SELECT pr.label AS c, p.label AS l, count(*) AS n FROM pr JOIN p ON p.id = pr.id GROUP BY 1, 2) SELECT round(100.0 * sum(top) / sum(n), 6) + 0.0 AS purity FROM (SELECT c, max(n) AS top, sum(n) AS n FROM m GROUP BY c)")
def purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.purity(points(spark, sf_dir), predicted(spark, sf_dir).withColumnRenamed("label", "cluster"))[0].select(r6("purity").alias("purity"))


#: Trial results made of a fact table: accuracy by model (market segment) and number of labels.
RESULTS = "res AS (SELECT c_mktsegment AS model, (c_nationkey % 5 + 1) * 10 AS num_train, c_acctbal / 100 AS accuracy FROM customer)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("model"), ((F.col("c_nationkey") % 5 + 1) * 10).cast("int").alias("num_train"), (F.col("c_acctbal") / 100).alias("accuracy"))


@query(f"WITH {RESULTS} SELECT num_train::INTEGER AS num_train, round(avg(accuracy), 6) + 0.0 AS mean, round(stddev_pop(accuracy), 6) + 0.0 AS std, count(*) AS trials FROM res GROUP BY num_train")
def trial_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.trial_statistics(_results(spark, sf_dir)).select("num_train", r6("mean").alias("mean"), r6("std").alias("std"), "trials")


@query(f"WITH {RESULTS}, st AS (SELECT model, num_train, avg(accuracy) AS mean, stddev_pop(accuracy) AS std FROM res GROUP BY 1, 2) SELECT model, num_train::INTEGER AS num_train, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, rank() OVER (PARTITION BY num_train ORDER BY mean DESC) = 1 AS best FROM st")
def accuracy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.accuracy_ranks(_results(spark, sf_dir)).select("model", "num_train", r6("mean").alias("mean"), r6("std").alias("std"), "best")


@query(f"WITH {RESULTS} SELECT model, num_train::INTEGER AS num_train, round(avg(accuracy), 6) + 0.0 AS mean, round(stddev_pop(accuracy), 6) + 0.0 AS std, count(*) AS trials FROM res GROUP BY 1, 2")
def accuracy_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.accuracy_curves(_results(spark, sf_dir)).select("model", "num_train", r6("mean").alias("mean"), r6("std").alias("std"), "trials")


#: Rates 1 and 2 are numbers of labels for each class, 0.1 a share of it; each in three trials.
SETS = "tr AS (SELECT t AS trial, [1, 2, 0.1][t // 3 + 1] AS rate FROM range(9) r(t)), rk AS (SELECT trial, id, rate, row_number() OVER (PARTITION BY trial, label ORDER BY md5(id || ':' || trial || ':0'), id) AS k, count(*) OVER (PARTITION BY trial, label) AS size FROM p, tr WHERE label >= 0), ts AS (SELECT trial::INTEGER AS trial, id FROM rk WHERE k <= CASE WHEN rate >= 1 THEN rate ELSE floor(size * rate) END)"


@query(f"WITH {P}, {SETS} SELECT trial, id FROM ts")
def train_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.training_sets(points(spark, sf_dir), [1, 2, 0.1], trials=3)


@query(f"WITH {P}, {SETS} SELECT trial, id FROM ts")
def train_sets_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training sets drawn, written, and read again."""
    with kept(spark, "sets") as path:
        return cut(datasets.saved_training_sets(points(spark, sf_dir), [1, 2, 0.1], path, trials=3))


@query(f"WITH {NN} SELECT src, dst, round(dist, 6) + 0.0 AS dist, rank FROM nn WHERE rank <= 5")
def knn_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours searched, written, and some ranks of them read again."""
    with kept(spark, "neighbours") as path:
        datasets.saved_knn(points(spark, sf_dir).select("id", "x"), 10, path)
        return cut(datasets.load_knn(spark, path, 5)).select("src", "dst", r6("dist").alias("dist"), "rank")


@query(f"WITH {E} SELECT src, dst, round(w, 6) + 0.0 AS w FROM e")
def graph_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written and read again."""
    with kept(spark, "graph") as path:
        datasets.save_graph(*graph(spark, sf_dir), path, name="neighbours")
        return cut(datasets.load_graph(spark, path)[1]).select("src", "dst", r6("w").alias("w"))


#: Moves of the class weights, each by the gap of all class sizes; the first weight stays 1.
MOVES = (
    "pri AS (SELECT label::INTEGER AS cls, count(*) / sum(count(*)) OVER ()::DOUBLE AS prior FROM p GROUP BY label), sz AS (SELECT count(DISTINCT id) AS n, min(u) AS lo, max(u) AS hi FROM sc), "
    "it(k, cls, w, gap) AS (SELECT 0, cls, 1.0::DOUBLE, 1.0::DOUBLE FROM pri UNION ALL "
    "SELECT k + 1, cls, CASE WHEN g <= 1e-3 THEN w ELSE new / first_value(new) OVER (ORDER BY cls) END, g FROM (SELECT k, cls, w, w - 0.1 * off AS new, max(abs(off)) OVER () AS g FROM ("
    "SELECT k, z.cls, any_value(z.w) AS w, sum(CASE WHEN r = 1 THEN 1 ELSE 0 END) / any_value(n)::DOUBLE - any_value(prior) AS off FROM ("
    "SELECT it.k, it.cls, it.w, sz.n, pri.prior, row_number() OVER (PARTITION BY sc.id ORDER BY (sc.u - lo) / (hi - lo) * it.w DESC, it.cls) AS r FROM it JOIN sc ON sc.cls = it.cls JOIN pri ON pri.cls = it.cls, sz WHERE it.k < 300 AND it.gap > 1e-3) z GROUP BY k, z.cls)))"
)


@query(f"WITH RECURSIVE {SCORES}, {MOVES}, fin AS (SELECT cls, w FROM it WHERE k = (SELECT max(k) FROM it)) SELECT id, arg_max(cls, {{'s': (u - lo) / (hi - lo) * w, 'c': -cls}})::INTEGER AS label FROM sc JOIN fin USING (cls), sz GROUP BY id")
def volume_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions whose class sizes follow the priors."""
    s, priors = scores(spark, sf_dir), [r.prior for r in ssl.class_priors(points(spark, sf_dir)).orderBy("cls").collect()]
    return ssl.predict(s, ssl.volume_projection(s, priors, max_iter=300))


U_SQL = f"WITH {SCORES}, a AS (SELECT id, list(u ORDER BY cls) AS u FROM sc GROUP BY id), s AS (SELECT id, u, list_reverse_sort(u) AS v FROM a)"
MEASURE_SQL = {
    "norm": "sqrt(list_sum(list_transform(range(1, len(u) + 1), lambda i: pow(exp(u[i] - v[1]) / list_sum(list_transform(u, lambda x: exp(x - v[1]))) - CASE WHEN i = list_position(u, v[1]) THEN 1 ELSE 0 END, 2))))",
    "entropy": "(1 - list_sum(list_transform(u, lambda y: exp(y - v[1]) * ln(exp(y - v[1]) / list_sum(list_transform(u, lambda x: exp(x - v[1]))) + 1e-5)))) / list_sum(list_transform(u, lambda x: exp(x - v[1])))",
    "least_confidence": "1 - v[1]",
    "smallest_margin": "1 - (v[1] - v[2])",
    "largest_margin": "1 - (v[1] - v[-1])",
    "unc_2norm": "1 - sqrt(list_sum(list_transform(u, lambda x: x * x)))",
}


def _measure(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return active.uncertainty(scores(spark, sf_dir), name).select("id", r6("a").alias("a"))


for _name, _sql in MEASURE_SQL.items():
    query(f"{U_SQL} SELECT id, round({_sql}, 6) + 0.0 AS a FROM s", _name if _name.startswith("unc_") else f"unc_{_name}")(partial(_measure, _name))

#: A kernel over pairs of nodes: the graph's weights with ones on the diagonal.
KERNEL = f"{SCORES}, kc AS (SELECT src AS i, dst AS j, w AS c FROM e UNION ALL SELECT id, id, 1.0 FROM p), kk AS (SELECT j AS id, sum(c * c) AS sq, sum(c) AS s, sum(CASE WHEN i = j THEN c ELSE 0 END) AS d FROM kc GROUP BY j), mg AS (SELECT id, 1 - (v[1] - v[2]) AS a FROM (SELECT id, list_reverse_sort(list(u)) AS v FROM sc GROUP BY id))"


def kernel(spark: SparkSession, sf_dir: str, made: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    nodes, edges = made or graph(spark, sf_dir)
    return edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("c")).unionByName(nodes.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("c")))


@query(f"WITH {KERNEL} SELECT id, round(sq / (0.01 + d), 6) + 0.0 AS a FROM kk")
def var_opt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active.variance(kernel(spark, sf_dir)).select("id", r6("a").alias("a"))


@query(f"WITH {KERNEL} SELECT id, round(s * s / (0.01 + d), 6) + 0.0 AS a FROM kk")
def sigma_opt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active.sigma(kernel(spark, sf_dir)).select("id", r6("a").alias("a"))


@query(f"WITH {KERNEL} SELECT id, round(a * sqrt(sq) / (0.01 + d), 6) + 0.0 AS a FROM kk JOIN mg USING (id)")
def model_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = graph(spark, sf_dir)  # once for both
    return active.model_change(kernel(spark, sf_dir, made), scores(spark, sf_dir, made)).select("id", r6("a").alias("a"))


@query(f"WITH {KERNEL} SELECT id, round(a * sq / (0.01 + d), 6) + 0.0 AS a FROM kk JOIN mg USING (id)")
def model_change_var_opt(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = graph(spark, sf_dir)  # once for both
    return active.model_change_variance(kernel(spark, sf_dir, made), scores(spark, sf_dir, made)).select("id", r6("a").alias("a"))


@query(f"WITH {KERNEL} SELECT id, round(a, 6) + 0.0 AS a FROM mg WHERE id NOT IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM p) WHERE r <= 3) ORDER BY round(a, 9) DESC, id LIMIT 20")
def select_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty least certain nodes without a label."""
    values = active.uncertainty(scores(spark, sf_dir)).withColumn("a", F.round("a", 9))
    return active.select_queries(values.join(training(spark, sf_dir).select("id"), "id", "left_anti"), 20).select("id", r6("a").alias("a"))


@query(f"WITH {KERNEL}, k AS (SELECT min(id) AS k FROM p), col AS (SELECT i, c FROM kc, k WHERE j = k), dk AS (SELECT c AS dk FROM col, k WHERE i = k) SELECT kc.i, kc.j, round(kc.c - a.c * b.c / (0.01 + dk), 6) + 0.0 AS c FROM kc JOIN col a ON a.i = kc.i JOIN col b ON b.i = kc.j, dk")
def kernel_downdate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel after the first node is labelled, where it changes."""
    return active.downdate(kernel(spark, sf_dir), points(spark, sf_dir).agg(F.min("id")).first()[0]).select("i", "j", r6("c").alias("c"))


#: The kernel over all pairs as nodes 1 to 3 are labelled one after another.
LABELLED = ", ".join(["c0 AS (SELECT a.id AS i, b.id AS j, coalesce(c, 0) AS c FROM p a CROSS JOIN p b LEFT JOIN kc ON kc.i = a.id AND kc.j = b.id), first3 AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM p QUALIFY r <= 3)", *[f"k{r} AS (SELECT i, c, max(CASE WHEN i = j THEN c END) OVER () AS d FROM c{r - 1} WHERE j = (SELECT id FROM first3 WHERE r = {r})), c{r} AS (SELECT x.i, x.j, x.c - a.c * b.c / (0.01 + a.d) AS c FROM c{r - 1} x JOIN k{r} a ON a.i = x.i JOIN k{r} b ON b.i = x.j)" for r in (1, 2, 3)]])


@query(f"WITH {KERNEL}, {LABELLED}, n3 AS (SELECT j AS id, sum(c * c) AS sq, sum(c) AS s, max(CASE WHEN i = j THEN c END) AS d FROM c3 GROUP BY j) SELECT id, round(sq / (0.01 + d), 6) + 0.0 AS var_opt, round(s * s / (0.01 + d), 6) + 0.0 AS sigma_opt FROM n3")
def lazy_downdates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both optimality values after the first three nodes are labelled one by one, without a table of pairs."""
    lazy = active.LazyKernel(kernel(spark, sf_dir))
    for r in points(spark, sf_dir).select("id").orderBy("id").limit(3).collect():
        lazy.update(r.id)
    return lazy.variance().select("id", r6("a").alias("var_opt")).join(lazy.sigma().select("id", r6("a").alias("sigma_opt")), "id")


@query("WITH c AS (SELECT c_acctbal AS x, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT sum(n) AS bn, sum(x * n) AS s, sum(x * x * n) AS q FROM c), r AS (SELECT x, sum(n) OVER o AS n1, sum(x * n) OVER o AS s1 FROM c WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)), g AS (SELECT x, s1 * s1 / n1 + (s - s1) * (s - s1) / (bn - n1) AS gain, s, q, bn FROM r, t WHERE n1 < bn) SELECT round((q - gain) / (q - s * s / bn), 6) + 0.0 AS w, x AS threshold FROM g ORDER BY gain DESC, x LIMIT 1")
def withinss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best split of account balances in two."""
    return cluster.withinss(table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x"))).select(r6("w").alias("w"), "threshold")


#: An image made of the embeddings: a row for each vector, a column for each coordinate.
@query("WITH px AS (SELECT vec_id AS r, generate_subscripts(embedding, 1) - 1 AS c, unnest(embedding)::DOUBLE AS v FROM embeddings), t AS (SELECT (r // 7) * 13 + c // 5 AS patch, (r % 7) * 5 + c % 5 AS pos, v FROM px), n AS (SELECT max(patch) AS m FROM t) SELECT patch::BIGINT AS patch, pos::INTEGER AS pos, round(coalesce(v, 0), 6) + 0.0 AS v FROM (SELECT unnest(range(0, ((SELECT max(vec_id) FROM embeddings) // 7 + 1) * 13)) AS patch) CROSS JOIN range(0, 35) a(pos) LEFT JOIN t USING (patch, pos)")
def image_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = points(spark, sf_dir).select(F.col("id").alias("row"), F.posexplode("x").alias("col", "v")).select("row", "col", F.lit(0).alias("ch"), "v")
    rows = px.agg(F.max("row")).first()[0] + 1
    return images.image_to_patches(px, 7, 5, (rows, 64, 1)).select("patch", F.posexplode("x").alias("pos", "v")).select("patch", "pos", r6("v").alias("v"))


@query("WITH o AS (SELECT vec_id, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings QUALIFY k < 12), c AS (SELECT k, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS v FROM o) SELECT ((k // 4) * 9 + i // 8)::INTEGER AS row, ((k % 4) * 9 + i % 8)::INTEGER AS col, 0 AS ch, round(v, 6) + 0.0 AS v FROM c")
def image_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mosaic of the first twelve vectors as eight by eight images."""
    return images.image_grid(points(spark, sf_dir), 3, 4, 8, 8).select("row", "col", "ch", r6("v").alias("v"))


@query("SELECT try_cast(o_clerk AS DOUBLE) AS c0, total AS c1 FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Date/Time' ELSE o_orderkey::VARCHAR END AS o_clerk, o_totalprice AS total FROM orders) WHERE NOT regexp_matches(o_clerk, '[A-Za-z]')")
def csv_numeric_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of text whose first cell has no letters, as numbers."""
    raw = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "Date/Time").otherwise(F.col("o_orderkey").cast("string")).alias("c0"), F.col("o_totalprice").cast("string").alias("c1"))
    return datasets.numeric_rows(raw, ["c0", "c1"])


@query(
    f"WITH {NN}, e AS (SELECT src, dst FROM nn WHERE rank <= 9), deg AS (SELECT src AS id, count(*)::DOUBLE AS d FROM e GROUP BY src), "
    "nu0 AS (SELECT e.src AS id, generate_subscripts(a.x, 1) AS k, unnest(a.x) AS xi, unnest(b.x) AS xj, 1 / deg.d AS w FROM e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst JOIN deg ON deg.id = e.dst), "
    "nu1 AS (SELECT id, list(v ORDER BY k) AS nu FROM (SELECT id, k, sum(w * (xj - xi)) AS v FROM nu0 GROUP BY id, k) GROUP BY id), "
    "nu AS (SELECT id, list_transform(nu, lambda v: v / sqrt(list_inner_product(nu, nu))) AS nu FROM nu1), "
    "m AS (SELECT e.src AS id, max(list_inner_product(list_transform(list_zip(a.x, b.x), lambda z: z[1] - z[2]), CASE WHEN list_inner_product(s.nu, t.nu) <= 0 THEN s.nu ELSE list_transform(list_zip(s.nu, t.nu), lambda z: (z[1] + z[2]) / 2) END)) AS t FROM e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst JOIN nu s ON s.id = e.src JOIN nu t ON t.id = e.dst GROUP BY e.src) "
    "SELECT p.id, round(greatest(coalesce(t, 0), 0), 6) + 0.0 AS t FROM p LEFT JOIN m USING (id)"
)
def boundary_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.boundary_statistic(points(spark, sf_dir).select("id", "x"), k=10).select("id", r6("t").alias("t"))
