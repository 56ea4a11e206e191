"""Semi-supervised classifiers on a graph.

A model's ``fit`` returns class scores in long form (id, cls, u); ``predict`` decides in DataFrame
functions.  Training labels are (id, label) with labels 0, 1, ...; negative labels mean none.  All
classes are solved at once.  ``plan`` is local (numpy, for graphs of checked size), distributed
(joins), or auto, by size: both solve the same equations.  Three models have no distributed plan and
say so by an error on larger graphs: dynamic label propagation (its kernel is a dense matrix),
volume-constrained MBO (an auction, bid by bid), and Laplace of order 2 and more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import blocks, linear, local, nonlinear, paths
from weftgraph.operators.calculus import degrees, laplacian, reweight_properly, reweight_wnll
from weftgraph.operators.fixpoint import cut


#: Entries of a block of sparse label propagation, of which a task holds one class: some 0.5 GB.
PROPAGATED = 1 << 24


@dataclass
class Graph:
    """Nodes (id) and symmetric edges (src, dst, w); points (id, x) where a model needs positions; cached eigenpairs."""

    nodes: DataFrame
    edges: DataFrame
    points: DataFrame | None = None
    cache: dict = field(default_factory=dict)

    def local(self) -> local.Local:
        if "local" not in self.cache:
            self.cache["local"] = local.gather(self.nodes, self.edges)
        return self.cache["local"]

    def fits(self) -> bool:
        if "fits" not in self.cache:
            self.cache["fits"] = local.fits(self.nodes, self.edges)
        return self.cache["fits"]

    def degrees(self) -> DataFrame:
        if "degrees" not in self.cache:
            self.cache["degrees"] = cut(degrees(self.nodes, self.edges))
        return self.cache["degrees"]

    def eigen_joins(self, k: int, kind: str = "normalized", gamma: float = 0.0, tol: float = 1e-6) -> tuple[np.ndarray, DataFrame]:
        """Eigenpairs that aren't solved in one place: values, and vectors as (id, v0, v1, ...)."""
        key = ("eigen_joins", k, kind, gamma, tol)
        if key not in self.cache:
            self.cache[key] = linear.eigen_decomp(self.nodes, self.edges, k, kind, gamma=gamma, tol=tol, plan="distributed")
        return self.cache[key]

    def eigen(self, k: int, kind: str = "normalized", gamma: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        key = ("eigen", k, kind, gamma)
        if key not in self.cache:
            self.cache[key] = linear.eigen_local(self.local(), k, kind, gamma=gamma)
        return self.cache[key]


def class_priors(labels: DataFrame, col: str = "label") -> DataFrame:
    """cls, prior: shares of the classes, ignoring negative labels."""
    total = Window.partitionBy(F.lit(1))
    counts = labels.where(F.col(col) >= 0).groupBy(F.col(col).cast("int").alias("cls")).agg(F.count("*").alias("n"))
    return counts.select("cls", (F.col("n") / F.sum("n").over(total)).alias("prior"))


def onehot(labels: DataFrame, col: str = "label", standardize: bool = False) -> DataFrame:
    """id, cls, u: 1 at a node's own class and 0 at the others; standardised labels are dense ranks."""
    y = labels.select("id", F.col(col).cast("int").alias("label"))
    known = y.select("label").distinct().withColumn("cls", (F.row_number().over(Window.orderBy("label")) - 1).cast("int")) if standardize else y.select("label", F.col("label").alias("cls")).distinct()
    y = y.join(known.withColumnRenamed("cls", "own"), "label").select("id", "own")
    classes = known.select("cls")
    return y.join(F.broadcast(classes), F.lit(True)).select("id", "cls", F.when(F.col("own") == F.col("cls"), 1.0).otherwise(0.0).alias("u"))


def predict(scores: DataFrame, weights: Sequence[float] | None = None, similarity: bool = True) -> DataFrame:
    """id, label: the class of greatest score (least, for distances) after one min-max scale and class weights; ties to the lowest class."""
    span = scores.agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    u = (F.col("u") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    if weights is not None:
        u = u * F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("cls") + 1)
    scaled = scores.join(F.broadcast(span), F.lit(True)).select("id", "cls", (u if similarity else -u).alias("s"))
    return scaled.groupBy("id").agg(F.max_by("cls", F.struct("s", -F.col("cls"))).cast("int").alias("label"))


def volume_projection(scores: DataFrame, priors: Sequence[float], similarity: bool = True, step: float = 0.1, tol: float = 1e-3, max_iter: int = 10_000) -> list[float]:
    """Class weights (the first is 1) whose decisions have class sizes within tol of the priors; moved by step times the gap."""
    priors = np.asarray(priors, float) / np.sum(priors)
    k, w = len(priors), np.ones(len(priors))
    wide = cut(scores.groupBy("id").pivot("cls", list(range(k))).agg(F.first("u")))
    lo, hi = scores.agg(F.min("u"), F.max("u")).first()
    span = hi - lo if hi > lo else 1.0
    n = wide.count()
    if n <= local.MAX_NODES:
        u = (wide.toPandas()[[str(c) for c in range(k)]].to_numpy() - lo) / span
        sizes = lambda w: np.bincount(((u * w) if similarity else -(u * w)).argmax(1), minlength=k) / n
    elif similarity and len(kinds := wide.groupBy(*[str(c) for c in range(k)]).count().limit(65).collect()) <= 64:  # as one-hot scores are
        u, each = (np.array([list(r)[:k] for r in kinds]) - lo) / span, np.array([r["count"] for r in kinds], float)
        sizes = lambda w: np.bincount((u * w).argmax(1), each, minlength=k) / n
    elif similarity:

        def at(w: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            got = _packed_sizes(wide, lambda b: np.stack([b.column(1 + c).to_numpy(zero_copy_only=False) for c in range(k)], 1), lo, span, w, reach)
            return got[0], got[1].reshape(-1, k), got[2]

        return _moved_weights(at, n, priors, step, tol, max_iter).tolist()
    else:

        def sizes(w: np.ndarray) -> np.ndarray:
            s = [(F.col(str(c)) - lo) / span * float(x) for c, x in enumerate(w)]
            best = F.array_position(F.array(*s), F.greatest(*s) if similarity else F.least(*s)) - 1
            got = {r.c: r["count"] for r in wide.groupBy(best.alias("c")).count().collect()}
            return np.array([got.get(c, 0) / n for c in range(k)])

    for _ in range(max_iter):
        gap = sizes(w) - priors
        if np.abs(gap).max() <= tol:
            break
        w = w + (-step if similarity else step) * gap
        w = w / w[0]
    return w.tolist()


def long_scores(g: local.Local, u: np.ndarray, spark) -> DataFrame:
    k = u.shape[1]
    return spark.createDataFrame(pd.DataFrame({"id": np.repeat(g.ids, k), "cls": np.tile(np.arange(k, dtype=np.int32), g.n), "u": u.ravel()})).select("id", F.col("cls").cast("int"), "u")


class Model:
    """A classifier: subclasses give scores; ``similarity`` says whether greater means likelier."""

    similarity = True

    #: Whether its equations are solved on packed blocks at every size, unless numpy is asked for by name.
    in_blocks = False

    def __init__(self, graph: Graph, plan: str = "auto", priors: Sequence[float] | None = None):
        self.graph, self.plan, self.priors, self.weights = graph, plan, priors, None

    def _scores(self, train: DataFrame, k: int) -> DataFrame:
        if not self._is_local():
            cols = [f"u{c}" for c in range(k)]
            return wide_to_long(self._joins(train, cols), cols)
        g = self.graph.local()
        at, y = self._train(train)
        return long_scores(g, self._local(g, at, y, k), self.graph.nodes.sparkSession)

    def _local(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        raise NotImplementedError

    def _joins(self, train: DataFrame, cols: list[str]) -> DataFrame:
        """Scores as a column for each class, by joins."""
        raise ValueError(f"{self.name()} is solved for graphs of checked size only: at most {local.MAX_NODES} nodes and {local.MAX_EDGES} edges")

    def _train(self, train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        p = train.where("label >= 0").select("id", "label").toPandas().sort_values("id")
        return self.graph.local().index(p["id"].to_numpy()), p["label"].to_numpy(int)

    def _is_local(self) -> bool:
        if self.in_blocks:
            return self.plan == "local"
        return self.plan == "local" or self.plan == "auto" and self.graph.fits()

    def prepare(self) -> None:
        """Make what several fits share."""
        if self._is_local():
            self.graph.local()

    def fit(self, train: DataFrame) -> DataFrame:
        k = int(train.agg(F.max("label")).first()[0]) + 1
        scores = self._scores(train, k)
        if self.priors is not None:
            scores = cut(scores)
            self.weights = volume_projection(scores, self.priors, self.similarity)
        return scores

    def predict(self, scores: DataFrame) -> DataFrame:
        return predict(scores, self.weights, self.similarity)

    def fit_predict(self, train: DataFrame) -> DataFrame:
        return self.predict(self.fit(train))

    def set_graph(self, graph: Graph) -> None:
        self.graph = graph

    def name(self) -> str:
        return type(self).__name__.lower()


def _hot(train: DataFrame, cols: list[str]) -> DataFrame:
    """id and a column for each class, 1 at a labelled node's own."""
    return train.where("label >= 0").select("id", *[F.when(F.col("label") == c, 1.0).otherwise(0.0).alias(name) for c, name in enumerate(cols)])


def _centred(train: DataFrame, cols: list[str]) -> DataFrame:
    """The same less each column's mean."""
    hot = _hot(train, cols)
    means = hot.agg(*[F.avg(c) for c in cols]).first()
    return hot.select("id", *[(F.col(c) - float(m)).alias(c) for c, m in zip(cols, means, strict=True)])


def _filled(nodes: DataFrame, values: DataFrame, cols: list[str], names: list[str]) -> DataFrame:
    """A row for each node: the columns under other names, zero where a node has none."""
    return nodes.select("id").join(values.select("id", *cols), "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in zip(cols, names, strict=True)])


def _argmax_hot(cols: list[str], weights: Sequence[float] | None = None) -> list[Column]:
    """One-hot columns of the first greatest value."""
    u = [F.col(c) * float(w) for c, w in zip(cols, weights if weights is not None else [1.0] * len(cols), strict=True)]
    best = F.array_position(F.array(*u), F.greatest(*u)) - 1 if len(u) > 1 else F.lit(0)
    return [F.when(best == c, 1.0).otherwise(0.0).alias(name) for c, name in enumerate(cols)]


def _from_basis(v: DataFrame, basis: list[str], m: np.ndarray, cols: list[str], more: Sequence[str] = ()) -> DataFrame:
    """The columns V m, and further columns of v."""
    return v.selectExpr("id", *more, *[" + ".join(f"{linear.number(a)} * {b}" for a, b in zip(m[:, j], basis, strict=True)) + f" AS {c}" for j, c in enumerate(cols)])


def _onto_basis(both: DataFrame, basis: list[str], values: list[str]) -> np.ndarray:
    """V^T of some columns (summed in each task first): basis by columns, whatever the number of nodes."""
    got = both.selectExpr(*[f"sum({b} * ({v}))" for b in basis for v in values]).first()
    return np.array(got, float).reshape(len(basis), len(values))


def _labelled(x: DataFrame, train: DataFrame) -> DataFrame:
    """Basis rows (id, v0, ...) with the label y, -1 where there is none."""
    return x.join(train.where("label >= 0").select("id", F.col("label").cast("int").alias("y")), "id", "left").withColumn("y", F.coalesce("y", F.lit(-1)))


def _basis_rows(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of id, k basis columns, y and c0 the basis, y and c0."""
    v = np.stack([b.column(1 + j).to_numpy() for j in range(k)], 1) if k else np.zeros((b.num_rows, 0))
    return v, b.column(1 + k).to_numpy(), b.column(2 + k).to_numpy()


def _over_rows(rows: DataFrame, k: int, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sums of what ``f`` makes of some rows at a time, partly summed in each task."""
    size = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += f(*_basis_rows(b, k)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out.reshape(shape)


def _by_rows(rows: DataFrame, k: int, cols: list[str], f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """id and the columns that ``f`` makes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = f(*_basis_rows(b, k))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(u[:, j])) for j in range(len(cols))]], ["id", *cols])

    return rows.mapInArrow(run, ", ".join(["id long", *[f"{c} double" for c in cols]]))


def _basis_products(rows: DataFrame, k: int, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """V^T V over all rows and over the labelled ones, and V^T of the labels one-hot."""

    def f(v: np.ndarray, y: np.ndarray, c0: np.ndarray) -> np.ndarray:
        some = v[y >= 0]
        return np.concatenate([(v.T @ v).ravel(), (some.T @ some).ravel(), (some.T @ np.eye(c)[y[y >= 0]]).ravel()])

    got = _over_rows(rows, k, f, (2 * k * k + k * c,))
    return got[: k * k].reshape(k, k), got[k * k : 2 * k * k].reshape(k, k), got[2 * k * k :].reshape(k, c)


def wide_to_long(wide: DataFrame, cols: list[str]) -> DataFrame:
    return wide.select("id", F.posexplode(F.array(*cols)).alias("cls", "u")).select("id", F.col("cls").cast("int"), "u")


class Laplace(Model):
    """Harmonic extension of the labels; reweighting none, poisson, wnll or properly; killing tau; power m; mean shift."""

    def __init__(self, graph: Graph, reweighting: str = "none", normalization: str = "combinatorial", tau: float = 0.0, order: int = 1, mean_shift: bool = False, tol: float = 1e-5, alpha: float = 2.0, zeta: float = 1e7, r: float = 0.1, **more):
        super().__init__(graph, **more)
        self.reweighting, self.normalization, self.tau, self.order, self.mean_shift, self.tol, self.alpha, self.zeta, self.r = reweighting, normalization, tau, order, mean_shift, tol, alpha, zeta, r

    def _edges(self, train: DataFrame) -> DataFrame:
        g = self.graph
        if self.reweighting == "none":
            return g.edges
        if self.reweighting == "poisson":
            return linear.reweight_poisson(g.nodes, g.edges, train, self.normalization == "normalized")
        if self.reweighting == "wnll":
            return reweight_wnll(g.nodes, g.edges, train)
        if self.reweighting == "properly":
            if g.points is None:
                raise ValueError("properly weighted Laplace needs the points")
            return reweight_properly(g.points, g.edges, train, self.alpha, self.zeta, self.r)
        raise ValueError("reweighting is none, poisson, wnll or properly")

    def _scores(self, train: DataFrame, k: int) -> DataFrame:
        nodes, edges = self.graph.nodes, cut(self._edges(train))
        cols = [f"u{c}" for c in range(k)]
        if self.order == 1:
            a = laplacian(nodes, edges, self.normalization)
            if self.tau:
                a = a.unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(float(self.tau)).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))
            bdy = train.where("label >= 0").select("id", *[F.when(F.col("label") == c, 1.0).otherwise(0.0).alias(cols[c]) for c in range(k)])
            wide = linear.constrained_solve(nodes, cut(a), None, bdy, cols, self.tol, plan=self.plan)
        else:
            # (tau + L)**order u = 0 off the labels: known values go to the right-hand side
            once = laplacian(nodes, edges, self.normalization).unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(float(self.tau)).alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))
            once, bdy = cut(once), _hot(train, cols)
            known = _filled(nodes, bdy, cols, cols)
            image = known
            for _ in range(self.order):
                image = linear.spmv(nodes, once, image, cols)
            u = blocks.conjgrad(nodes, once, image.select("id", *[(-F.col(c)).alias(c) for c in cols]), cols, self.tol, power=self.order, held=bdy)
            wide = u.join(bdy.select("id"), "id", "left_anti").unionByName(bdy)
        if self.mean_shift:
            means = wide.agg(*[F.avg(c) for c in cols]).first()
            wide = wide.select("id", *[(F.col(c) - float(m)).alias(c) for c, m in zip(cols, means, strict=True)])
        return wide_to_long(wide, cols)


class Poisson(Model):
    """L u = sum over labelled nodes of (onehot - mean): by conjugate gradients, gradient descent, or the spectrum."""

    in_blocks = True

    def __init__(self, graph: Graph, solver: str = "conjgrad", p: float = 1.0, tol: float = 1e-3, min_iter: int = 50, max_iter: int = 1000, eigenpairs: int = 50, **more):
        super().__init__(graph, **more)
        self.solver, self.p, self.tol, self.min_iter, self.max_iter, self.eigenpairs = solver if p == 1 else "spectral", p, tol, min_iter, max_iter, eigenpairs

    def _source(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        s = np.zeros((g.n, k))
        hot = np.eye(k)[y]
        s[at] = hot - hot.mean(0)
        return s

    def _local(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        s = self._source(g, at, y, k)
        d = np.where(g.degree > 0, g.degree, 1)[:, None]
        if self.solver == "conjgrad":
            root = np.sqrt(d)
            return local.conjgrad(g.laplacian("normalized"), s / root, tol=self.tol) / root
        if self.solver == "spectral":
            vals, vecs = self.graph.eigen(min(self.eigenpairs, g.n))
            keep = vals > 1e-8
            v = vecs[:, keep]
            return (v @ ((v.T @ (s / np.sqrt(d))) / vals[keep][:, None] ** self.p)) / np.sqrt(d)
        if self.solver != "gradient_descent":
            raise ValueError("solver is conjgrad, gradient_descent or spectral")
        u, walk, stationary = np.zeros_like(s), np.zeros(g.n), g.degree / g.degree.sum()
        walk[at] = 1 / len(at)
        for i in range(self.max_iter):
            if i >= self.min_iter and np.abs(walk - stationary).max() <= 1 / g.n:
                break
            u = (s + g.times_t(u)) / d
            walk = g.times_t(walk / d[:, 0])
        return u

    def _joins(self, train: DataFrame, cols: list[str]) -> DataFrame:
        nodes, edges = self.graph.nodes, self.graph.edges
        d = self.graph.degrees().select("id", F.when(F.col("d") > 0, F.col("d")).otherwise(1.0).alias("d"))
        source = _centred(train, cols)
        scaled = source.join(d, "id").select("id", *[(F.col(c) / F.sqrt("d")).alias(c) for c in cols])
        if self.solver == "conjgrad":
            v = linear.conjgrad(nodes, cut(laplacian(nodes, edges, "normalized")), scaled, cols, self.tol, plan=self.plan)
        elif self.solver == "spectral":
            vals, x = self.graph.eigen_joins(self.eigenpairs)
            basis = [c for c, value in zip(x.columns[1:], vals, strict=True) if value > 1e-8]
            kept = vals[vals > 1e-8]
            m = _onto_basis(x.join(scaled, "id"), basis, cols) / kept[:, None] ** self.p
            v = _from_basis(x, basis, m, cols)
        elif self.solver == "gradient_descent":
            return self._descent(source, d, cols)
        else:
            raise ValueError("solver is conjgrad, gradient_descent or spectral")
        return v.join(d, "id").select("id", *[(F.col(c) / F.sqrt("d")).alias(c) for c in cols])

    def _descent(self, source: DataFrame, d: DataFrame, cols: list[str]) -> DataFrame:
        """u <- (s + W^T u) / d until a walk from the labels has mixed, all in one product a round."""
        nodes, turned = self.graph.nodes, self.graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        n, labelled = nodes.count(), source.count()
        total = self.graph.degrees().agg(F.sum("d")).first()[0]
        base = _filled(nodes, source.withColumn("p", F.lit(1.0 / labelled)), [*cols, "p"], [*[f"s_{c}" for c in cols], "walk"]).join(d, "id")
        base = cut(base.join(self.graph.degrees().select("id", (F.col("d") / total).alias("rest")), "id"))
        state = base.select("id", "walk", *[F.lit(0.0).alias(c) for c in cols])
        for i in range(self.max_iter):
            if i >= self.min_iter and i % 5 == 0 and state.join(base.select("id", "rest"), "id").agg(F.max(F.abs(F.col("walk") - F.col("rest")))).first()[0] <= 1 / n:
                break
            spread = state.join(d, "id").select("id", (F.col("walk") / F.col("d")).alias("walk"), *cols)
            new = base.drop("walk").join(linear.spmv(nodes, turned, spread, ["walk", *cols]), "id")
            state = new.select("id", "walk", *[((F.col(f"s_{c}") + F.col(c)) / F.col("d")).alias(c) for c in cols])
            if (i + 1) % 5 == 0:
                state = cut(state)
        return state.select("id", *cols)


def poisson_descent(nodes: DataFrame, edges: DataFrame, train: DataFrame, k: int, rounds: int, every: int = 5) -> DataFrame:
    """So many rounds of u <- D^-1 (s + W^T u) as joins: id, cls, u."""
    cols = [f"u{c}" for c in range(k)]
    hot = train.where("label >= 0").select("id", *[F.when(F.col("label") == c, 1.0).otherwise(0.0).alias(cols[c]) for c in range(k)])
    means = hot.agg(*[F.avg(c) for c in cols]).first()
    src = hot.select("id", *[(F.col(c) - float(m)).alias(f"s_{c}") for c, m in zip(cols, means, strict=True)])
    base = cut(nodes.select("id").join(degrees(nodes, edges), "id").join(src, "id", "left").select("id", "d", *[F.coalesce(f"s_{c}", F.lit(0.0)).alias(f"s_{c}") for c in cols]))
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    u = base.select("id", *[F.lit(0.0).alias(c) for c in cols])
    for i in range(rounds):
        u = base.join(linear.spmv(nodes, turned, u, cols), "id").select("id", *[F.when(F.col("d") > 0, (F.col(f"s_{c}") + F.col(c)) / F.col("d")).otherwise(0.0).alias(c) for c in cols])
        if (i + 1) % every == 0:
            u = cut(u)
    return wide_to_long(u, cols)


def _project(u: np.ndarray, priors: np.ndarray, step: float = 0.1, tol: float = 1e-3, max_iter: int = 10_000) -> np.ndarray:
    """Labels by argmax of weighted scores, the weights moved until class sizes meet the priors."""
    u = (u - u.min()) / max(u.max() - u.min(), 1e-300)
    w = _moved_weights(lambda w, reach: _sizes_of(u, w, reach), len(u), priors, step, tol, max_iter, 1024)
    return (u * w).argmax(1)


#: Rows that may change class within the range of weights that one pass covers, brought to the driver (a bound).
OPEN_ROWS = 20_000
#: Relative changes of the weights that a pass may cover.
RANGES = (0.3, 0.1, 0.03, 0.01, 3e-3, 1e-3, 1e-4, 1e-5)


def _moved_weights(sizes: Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, priors: np.ndarray, step: float = 0.1, tol: float = 1e-3, max_iter: int = 10_000, most: int = OPEN_ROWS) -> np.ndarray:
    """Class weights moved by step times the gap of the class sizes until these meet the priors, by few passes over the rows.

    ``sizes(w, r)`` counts the rows by class whose class is the same for all weights within a relative r
    of w, gives the scaled scores of the others, and how many others there would be for each of ``RANGES``.
    The weights move on those alone until they leave the range; each move is the one of full counts.
    """
    w, moves = np.ones(len(priors)), 0
    while moves < max_iter:
        origin = w
        certain, rows, others = sizes(origin, 0.0)
        reach = max((r for r, x in zip(RANGES, others, strict=True) if x <= most), default=0.0)
        if reach:
            certain, rows, _ = sizes(origin, reach)
        while moves < max_iter and (np.abs(w - origin) <= reach * np.abs(origin)).all():
            gap = (certain + np.bincount((rows * w).argmax(1), minlength=len(w)) if len(rows) else certain) / n - priors
            if np.abs(gap).max() <= tol:
                return w
            w = w - step * gap
            w = w / w[0]
            moves += 1
    return w


def _sizes_of(u: np.ndarray, w: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scaled scores (0 and more) what ``_moved_weights`` asks for; where the greatest is 0, zeros and signs stay as they are."""
    v = u * w
    at, best = np.arange(len(v)), v.argmax(1)
    top = v[at, best].copy()[:, None]
    size = np.abs(v) + np.abs(top)
    # the least relative change of all weights at which another class may come first
    room = np.where(size > 0, (top - v) / np.where(size > 0, size, 1), np.inf)
    room[at, best] = np.inf
    room = np.where(top[:, 0] != 0, room.min(1, initial=np.inf), np.inf) * (1 - 1e-9)
    loose = room <= reach if reach else np.zeros(len(u), bool)
    return np.bincount(best[~loose], minlength=u.shape[1]), u[loose], np.array([(room <= r).sum() for r in RANGES])


def _packed_sizes(rows: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray], lo: float, span: float, w: np.ndarray, reach: float) -> list[np.ndarray]:
    """``_sizes_of`` over a table whose batches ``read`` turns to scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            certain, open_rows, others = _sizes_of((read(b) - lo) / span, w, reach)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (certain.astype(np.int64), open_rows, others.astype(np.int64))], ["certain", "rows", "others"])

    got = rows.mapInArrow(run, "certain binary, rows binary, others binary").collect()
    sums = [sum((np.frombuffer(r[c], np.int64) for r in got), np.zeros(1, np.int64)) for c in ("certain", "others")]
    return [sums[0], np.concatenate([np.frombuffer(r["rows"], np.float64) for r in got]), sums[1]]


def _project_blocks(m: blocks.Blocks, state: DataFrame, width: int, c: int, priors: np.ndarray) -> DataFrame:
    """The state with its last c columns one-hot, class sizes as near to the priors as ``_project`` brings them."""

    scores = lambda data: np.frombuffer(data.as_buffer(), np.float64).reshape(-1, width)[:, -c:]
    own = state.where("p = q")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in map(scores, b.column(2)):
                yield pa.RecordBatch.from_arrays([pa.array([float(u.min(initial=np.inf))]), pa.array([float(u.max(initial=-np.inf))]), pa.array([len(u)])], ["lo", "hi", "n"])

    lo, hi, n = own.mapInArrow(ends, "lo double, hi double, n long").agg(F.min("lo"), F.max("hi"), F.sum("n")).first()
    span = max(hi - lo, 1e-300)

    def sizes(w: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        certain, rows, others = _packed_sizes(own, lambda b: np.concatenate([scores(x) for x in b.column(2)]) if b.num_rows else np.zeros((0, c)), lo, span, w, reach)
        return certain, rows.reshape(-1, c), others

    w = _moved_weights(sizes, n, priors)
    pick: blocks.Step = lambda block, own, halo: np.concatenate([own[:, :-c], np.eye(c)[(((own[:, -c:] - lo) / span) * w).argmax(1)]], 1)
    return cut(m.steps(state, [pick], 0))


def _priors(model: Model, y: np.ndarray, k: int) -> np.ndarray:
    p = np.asarray(model.priors, float) if model.priors is not None else np.bincount(y, minlength=k).astype(float)
    return p / p.sum()


class PoissonMBO(Poisson):
    """Poisson scores, then rounds of heat steps with the source and a volume-constrained threshold."""

    def __init__(self, graph: Graph, rounds: int = 20, steps: int = 40, mu: float = 1.0, entries: int = blocks.ENTRIES, **more):
        super().__init__(graph, **more)
        self.rounds, self.steps, self.mu, self.entries = rounds, steps, mu, entries

    def _local(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        s, priors, lap, dt = self._source(g, at, y, k), _priors(self, y, k), g.laplacian(), 1 / g.degree.max()
        u = np.eye(k)[_project(super()._local(g, at, y, k), priors)]
        for _ in range(self.rounds):
            for _ in range(self.steps):
                u = u - dt * lap(u) + self.mu * dt * s
            u = np.eye(k)[_project(u, priors)]
        return u

    def _joins(self, train: DataFrame, cols: list[str]) -> DataFrame:
        """On packed blocks: a round's heat steps move vectors only; in one block all rounds are one step."""
        nodes, d, c = self.graph.nodes, self.graph.degrees(), len(cols)
        counts = {r.label: r.n for r in train.where("label >= 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
        priors = np.asarray(self.priors if self.priors is not None else [counts.get(x, 0) for x in range(c)], float)
        priors, dt, mu = priors / priors.sum(), 1 / d.agg(F.max("d")).first()[0], self.mu
        m = blocks.Blocks(nodes, self.graph.edges, self.entries)
        source, names = [f"s_{x}" for x in cols], [f"u_{x}" for x in cols]
        known = d.join(super()._joins(train, cols).toDF("id", *names), "id").join(_centred(train, cols).toDF("id", *source), "id", "left")
        state = cut(m.place(known, [*source, "d", *names]))

        def heat(block: blocks.Block, own: np.ndarray, halo: np.ndarray) -> np.ndarray:
            s, degree, u = own[:, :c], own[:, c : c + 1], own[:, -c:]
            return np.concatenate([own[:, : c + 1], u - dt * (degree * u - block.times(u, halo)) + mu * dt * s], 1)

        if m.count <= 1:
            rounds, steps = self.rounds, self.steps

            def solve(block: blocks.Block, own: np.ndarray, halo: np.ndarray) -> np.ndarray:
                decide = lambda x: np.concatenate([x[:, : c + 1], np.eye(c)[_project(x[:, -c:], priors)]], 1)
                own = decide(own)
                for _ in range(rounds):
                    for _ in range(steps):
                        own = heat(block, own, np.zeros((0, c)))
                    own = decide(own)
                return own

            state = cut(m.steps(state, [solve], 0))
        else:
            stay: blocks.Step = lambda block, own, halo: own
            state = _project_blocks(m, state, 2 * c + 1, c, priors)
            for _ in range(self.rounds):
                old, state = state, cut(m.steps(state, [stay, *[heat] * self.steps], c))
                blocks.forget(old)
                state = _project_blocks(m, state, 2 * c + 1, c, priors)
        return m.frame(state, np.eye(2 * c + 1)[:, c + 1 :], cols)


class VolumeMBO(Model):
    """Threshold dynamics whose class sizes keep within bounds by prices; priors are required.

    plan "blocks": the same in the task that holds the graph as one packed block.
    """

    def __init__(self, graph: Graph, temperature: float = 0.1, volume: float = 0.5, rounds: int = 100, seed: int = 0, **more):
        super().__init__(graph, **more)
        self.temperature, self.volume, self.rounds, self.seed = temperature, volume, rounds, seed

    def _local(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        from weftgraph.operators.auction import volume_mbo

        return np.eye(k)[volume_mbo(g, at, y, k, _priors(self, y, k), self.temperature, self.volume, self.rounds, self.seed)]

    def _joins(self, train: DataFrame, cols: list[str]) -> DataFrame:
        from weftgraph.operators.auction import volume_mbo

        if self.plan != "blocks":
            return super()._joins(train, cols)
        m, k = blocks.Blocks(self.graph.nodes, self.graph.edges, PROPAGATED), len(cols)
        if m.count > 1:
            raise ValueError(f"{self.name()} is solved on one block: at most {PROPAGATED} nodes and edges")
        state = cut(m.place(train.where("label >= 0").select("id", (F.col("label") + 1).alias("y")), ["y"]))
        priors = np.asarray(self.priors, float) / np.sum(self.priors)
        temperature, volume, rounds, seed = self.temperature, self.volume, self.rounds, self.seed

        def solve(block: blocks.Block, own: np.ndarray, halo: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(own[:, 0] > 0)
            g = local.Local(block.ids, np.repeat(np.arange(len(block.ids)), np.diff(block.starts)), block.cols, block.w)
            return np.eye(k)[volume_mbo(g, at, own[at, 0].astype(int) - 1, k, priors, temperature, volume, rounds, seed)]

        return cut(m.frame(m.steps(state, [solve], 0), slice(0, k), cols))

    def fit(self, train: DataFrame) -> DataFrame:
        if self.priors is None:
            raise ValueError("volume-constrained MBO needs priors")
        return self._scores(train, int(train.agg(F.max("label")).first()[0]) + 1)


class MulticlassMBO(Model):
    """Spectral diffusion with fidelity to the labels, from a random start, thresholded each round."""

    def __init__(self, graph: Graph, steps: int = 6, rounds: int = 10, dt: float = 0.15, mu: float = 50.0, eigenpairs: int = 50, seed: int = 0, **more):
        super().__init__(graph, **more)
        self.steps, self.rounds, self.dt, self.mu, self.eigenpairs, self.seed = steps, rounds, dt, mu, eigenpairs, seed

    in_blocks = True

    def _start(self, k: int) -> Column:
        """The class a node starts in: a function of its id, the same in every plan."""
        return F.pmod(F.xxhash64(F.col("id").cast("long"), F.lit(self.seed)), F.lit(k))

    def _local(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        vals, x = self.graph.eigen(min(self.eigenpairs, g.n))
        h = self.dt / self.steps
        smooth = x / (1 + h * vals)
        known, mask = np.zeros((g.n, k)), np.zeros((g.n, 1))
        known[at, y], mask[at] = 1.0, 1.0
        start = self.graph.nodes.select(F.col("id").cast("long").alias("id"), self._start(k).cast("int").alias("c")).toPandas()
        u = np.zeros((g.n, k))
        u[g.index(start["id"].to_numpy()), start["c"].to_numpy()] = 1.0
        u[at] = known[at]
        for _ in range(self.rounds):
            for _ in range(self.steps):
                u = x @ (smooth.T @ (u - h * self.mu * mask * (u - known)))
            u = np.eye(k)[u.argmax(1)]
        return u

    def _joins(self, train: DataFrame, cols: list[str]) -> DataFrame:
        """A pass over the eigenvectors for each round: of the steps between two thresholds the vectors see only small products."""
        c, mu = len(cols), self.mu
        vals, x = self.graph.eigen_joins(self.eigenpairs, tol=1e-8)
        h, k = self.dt / self.steps, len(vals)
        rows = cut(_labelled(x, train).select("*", self._start(c).cast("int").alias("c0")))
        every, held, hot = _basis_products(rows, k, c)

        def first(v: np.ndarray, y: np.ndarray, c0: np.ndarray, m: np.ndarray | None) -> np.ndarray:
            u = np.eye(c)[np.where(y >= 0, y, c0) if m is None else (v @ m).argmax(1)]
            some = y >= 0
            u[some] -= h * mu * (u[some] - np.eye(c)[y[some]])
            return v.T @ u

        m = None
        for _ in range(self.rounds):
            m = _over_rows(rows, k, lambda v, y, c0, m=m: first(v, y, c0, m), (k, c)) / (1 + h * vals)[:, None]
            for _ in range(self.steps - 1):
                m = (every @ m - h * mu * (held @ m - hot)) / (1 + h * vals)[:, None]
        return _by_rows(rows, k, cols, lambda v, y, c0: np.eye(c)[np.where(y >= 0, y, c0) if m is None else (v @ m).argmax(1)])


class ModularityMBO(Model):
    """Diffusion in the eigenbasis of the Laplacian with a modularity term, thresholded until it settles; it starts at the labels and zero elsewhere."""

    def __init__(self, graph: Graph, gamma: float = 0.5, epsilon: float = 1.0, fidelity: float = 10.0, steps: int = 5, rounds: int = 100, **more):
        super().__init__(graph, **more)
        self.gamma, self.epsilon, self.fidelity, self.steps, self.rounds = gamma, epsilon, fidelity, steps, rounds

    in_blocks = True

    def _time(self, labelled: int, least: float, most_degree: float) -> float:
        """The geometric mean of a step that is surely too short and one that is too long; the norm of the start is that of the labels."""
        longest = max(np.log(np.sqrt(labelled) / self.epsilon), 1e-6) / max(least, 1e-12)
        return float(np.sqrt(0.15 / ((self.gamma + 1) * most_degree) * longest))

    def _local(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        vals, v = self.graph.eigen(min(5 * k, g.n), "combinatorial", self.gamma)
        u = np.zeros((g.n, k))
        u[at] = np.eye(k)[y]
        dt = self._time(len(at), vals[0], g.degree.max())
        heat = np.exp(-vals * dt)[:, None]
        h = dt / self.steps
        for _ in range(self.rounds):
            new = v @ (heat * (v.T @ u))
            for _ in range(self.steps):
                new[at] -= h * self.fidelity * (new[at] - np.eye(k)[y])
            new = np.eye(k)[new.argmax(1)]
            if (new == u).all():
                break
            u = new
        return u

    def _joins(self, train: DataFrame, cols: list[str]) -> DataFrame:
        c = len(cols)
        vals, x = self.graph.eigen_joins(5 * c, "combinatorial", self.gamma, tol=1e-8)
        k = len(vals)
        rows = cut(_labelled(x, train).withColumn("c0", F.lit(0)))
        _, _, u = _basis_products(rows, k, c)
        dt = self._time(train.where("label >= 0").count(), vals[0], self.graph.degrees().agg(F.max("d")).first()[0])
        # so many pulls towards a label: what is left of the distance
        left = (1 - dt / self.steps * self.fidelity) ** self.steps

        def decided(v: np.ndarray, y: np.ndarray, m: np.ndarray | None) -> np.ndarray:
            some = y >= 0
            out = np.zeros((len(v), c)) if m is None else v @ m
            known = np.eye(c)[y[some]]
            out[some] = known if m is None else known + left * (out[some] - known)
            return out if m is None else np.eye(c)[out.argmax(1)]

        def turn(v: np.ndarray, y: np.ndarray, c0: np.ndarray, old: np.ndarray | None, m: np.ndarray) -> np.ndarray:
            new = decided(v, y, m)
            return np.append((v.T @ new).ravel(), (new != decided(v, y, old)).any(1).sum())

        m = None
        for _ in range(self.rounds):
            old, m = m, np.exp(-vals * dt)[:, None] * u
            got = _over_rows(rows, k, lambda v, y, c0, old=old, m=m: turn(v, y, c0, old, m), (k * c + 1,))
            u = got[:-1].reshape(k, c)
            if got[-1] == 0:
                break
        return _by_rows(rows, k, cols, lambda v, y, c0: decided(v, y, m))


class DynamicLabelPropagation(Model):
    """A walk kernel that evolves with the labels: K <- P K P^T + alpha V V^T + lam I, V being P u.

    The kernel isn't made: K u takes r products with P^T and r + 1 with P in round r, and of each round
    the thin factor V (a column for each class) is kept.  plan "local": the dense kernel, in numpy.
    """

    in_blocks = True

    def __init__(self, graph: Graph, alpha: float = 0.05, lam: float = 0.1, rounds: int = 2, **more):
        super().__init__(graph, **more)
        self.alpha, self.lam, self.rounds = alpha, lam, rounds

    def _local(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        p = g.dense() / np.where(g.degree > 0, g.degree, 1)[:, None]
        pt, u, hot = p.copy(), np.zeros((g.n, k)), np.eye(k)[y]
        u[at] = hot
        for _ in range(self.rounds):
            v = p @ u
            u = pt @ u
            u[at] = hot
            pt = p @ pt @ p.T + self.alpha * v @ v.T + self.lam * np.eye(g.n)
        return u

    def _joins(self, train: DataFrame, cols: list[str]) -> DataFrame:
        nodes = self.graph.nodes
        d = self.graph.degrees().select(F.col("id").alias("src"), F.when(F.col("d") > 0, F.col("d")).otherwise(1.0).alias("d"))
        walk = cut(self.graph.edges.join(d, "src").select("src", "dst", (F.col("w") / F.col("d")).alias("w")))
        back = walk.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        held, thin = [f"h_{c}" for c in cols], [f"v_{c}" for c in cols]
        fixed = cut(nodes.select("id").join(_hot(train, cols).toDF("id", *held), "id", "left"))
        u = cut(fixed.select("id", *[F.coalesce(h, F.lit(0.0)).alias(c) for h, c in zip(held, cols, strict=True)]))
        factors: list[DataFrame] = []
        for r in range(self.rounds):
            images = [u]
            for _ in range(r):
                images.append(cut(linear.spmv(nodes, back, images[-1], cols)))
            out = cut(linear.spmv(nodes, walk, images[-1], cols))
            v = out if r == 0 else linear.spmv(nodes, walk, u, cols) if r + 1 < self.rounds else None
            for factor, image in zip(factors, images[-2::-1], strict=True):
                both = factor.join(image, "id")
                m = _onto_basis(both, thin, cols)
                own = both.select("id", *[(sum((self.alpha * float(m[i, j]) * F.col(t) for i, t in enumerate(thin)), self.lam * F.col(c))).alias(f"o_{c}") for j, c in enumerate(cols)])
                out = cut(linear.spmv(nodes, walk, out, cols).join(own, "id").select("id", *[(F.col(c) + F.col(f"o_{c}")).alias(c) for c in cols]))
            if v is not None:
                factors.append(cut(v.toDF("id", *thin)))
            u = cut(fixed.join(out, "id").select("id", *[F.coalesce(h, c).alias(c) for h, c in zip(held, cols, strict=True)]))
        return u


class CenteredKernel(Model):
    """Fixed point of u = H u / a off the labels, H being W (without loops) centred in rows and columns and a its top eigenvalue times alpha."""

    in_blocks = True

    def __init__(self, graph: Graph, tol: float = 1e-10, powers: int = 100, alpha: float = 1.05, max_iter: int = 10_000, entries: int = blocks.ENTRIES, **more):
        super().__init__(graph, **more)
        self.tol, self.powers, self.alpha, self.max_iter, self.entries = tol, powers, alpha, max_iter, entries

    def _local(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        g = g.with_weights(np.where(g.row == g.col, 0.0, g.w))

        def h(u: np.ndarray) -> np.ndarray:
            v = g.times(u - u.mean(0))
            return v - v.mean(0)

        v, top = np.random.default_rng(0).uniform(size=g.n), 1.0
        for _ in range(self.powers):
            w = h(v)
            top = abs(v @ w / (v @ v))
            v = w / np.linalg.norm(w)
        u = np.zeros((g.n, k))
        hot = np.eye(k)[y]
        u[at] = hot - hot.mean(0)
        fixed = u[at].copy()
        for _ in range(self.max_iter):
            new = h(u) / (self.alpha * top)
            new[at] = fixed
            done = np.abs(new - u).max() <= self.tol
            u = new
            if done:
                break
        return u

    def _joins(self, train: DataFrame, cols: list[str]) -> DataFrame:
        """On packed blocks: the means before and after a product are sums that every block gets with what it is sent."""
        nodes, edges, c = self.graph.nodes, cut(self.graph.edges.where("src <> dst")), len(cols)
        n, total = nodes.count(), float(edges.agg(F.sum("w")).first()[0] or 0.0)
        m = blocks.Blocks(nodes, edges, self.entries)
        sums: blocks.Shared = lambda block, u: np.concatenate([u.sum(0), -block.degree @ u])

        def h(block: blocks.Block, u: np.ndarray, halo: np.ndarray) -> np.ndarray:
            k = u.shape[1]
            both = sums(block, u) + block.dots
            mean, image = both[:k] / n, both[k:]
            return block.times(u, halo) + block.degree[:, None] * mean - (image - total * mean) / n

        stay: blocks.Step = lambda block, own, halo: own
        unit: blocks.Step = lambda block, own, halo: own / scale
        state, left, scale = cut(m.start(lambda ids: blocks.started(ids, 1, 0) + 0.5)), self.powers - 1, 1.0
        while left > 0:
            some = min(left, 10)  # the vector is brought to length one after so many
            state, left = cut(m.steps(state, [unit, *[h] * some], 1, sums)), left - some
            scale = max(float(np.sqrt(m.gram(state, 1)[0, 0])), 1e-300)
        g = m.gram(m.steps(state, [unit, lambda block, own, halo: np.concatenate([own, h(block, own, halo)], 1)], 1, sums), 2)
        by = self.alpha * abs(g[0, 1] / g[0, 0])

        def move(block: blocks.Block, own: np.ndarray, halo: np.ndarray) -> np.ndarray:
            u, held = own[:, 2:], own[:, 1:2] > 0
            new = np.where(held, u, h(block, u, halo) / by)
            return np.concatenate([np.abs(new - u).max(1, initial=0)[:, None], own[:, 1:2], new], 1)

        known = _centred(train, cols).withColumn("held", F.lit(1.0)).withColumn("gap", F.lit(0.0))
        state = cut(m.place(known, ["gap", "held", *cols]))
        if m.count <= 1:
            tol, rounds = self.tol, self.max_iter

            def solve(block: blocks.Block, own: np.ndarray, halo: np.ndarray) -> np.ndarray:
                for _ in range(rounds):
                    own = move(block, own, halo)
                    if own[:, 0].max(initial=0) <= tol:
                        break
                return own

            return cut(m.frame(m.steps(state, [solve], 0), slice(2, 2 + c), cols))
        for done in range(0, self.max_iter, 8):
            old, state = state, cut(m.steps(state, [stay, *[move] * min(8, self.max_iter - done)], c, sums))
            blocks.forget(old)
            if m.greatest(state, 2 + c) <= self.tol:
                break
        return cut(m.frame(state, slice(2, 2 + c), cols))


class SparseLabelPropagation(Model):
    """Primal-dual minimisation of the weighted l1 norm of gradients with labels fixed; the graph is symmetric, so an edge's dual is that of its reverse, negated."""

    in_blocks = True

    def __init__(self, graph: Graph, rounds: int = 100, entries: int = PROPAGATED, **more):
        super().__init__(graph, **more)
        self.rounds, self.entries = rounds, entries

    def _local(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        step = (1 / (2 * np.where(g.w > 0, g.w, 1)))[:, None]
        tau = (1 / np.where(g.degree > 0, g.degree, 1))[:, None]
        w = g.w[:, None]
        u, dual, fixed = np.zeros((g.n, k)), np.zeros((len(g.w), k)), np.eye(k)[y]
        for _ in range(self.rounds):
            div = np.stack([np.bincount(g.row, g.w * dual[:, c], g.n) for c in range(k)], 1)
            new = u - 2 * tau * div
            new[at] = fixed
            ahead = 2 * new - u
            dual = np.clip(dual - step * w * (ahead[g.col] - ahead[g.row]), -1, 1)
            u = new
        return u

    def _scores(self, train: DataFrame, k: int) -> DataFrame:
        if self._is_local():
            return super()._scores(train, k)
        return propagation_blocks(self.graph.nodes, self.graph.edges, train, k, self.rounds, self.entries)


def propagation_blocks(nodes: DataFrame, edges: DataFrame, train: DataFrame, k: int, rounds: int, entries: int = PROPAGATED) -> DataFrame:
    """id, cls, u: so many rounds of sparse label propagation, each class of a block in a task of its own.

    The duals of a block's entries are that task's; of several blocks the values ahead are sent, and the duals stay in the state.
    """
    m, spark = blocks.Blocks(nodes, edges, entries), nodes.sparkSession
    placed = m.place(train.where("label >= 0").select("id", (F.col("label") + 1).alias("y")), ["y"]).select("p", F.col("data").alias("y"))
    static = cut(m.table.join(placed, "p")).crossJoin(F.broadcast(spark.range(k).select(F.col("id").alias("c"))))

    def move(block: blocks.Block, y: np.ndarray, c: int, u: np.ndarray, ahead: np.ndarray | None, dual: np.ndarray, halo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The duals (in place) by the values ahead, and the new values and those ahead of them."""
        x = None if ahead is None else np.concatenate([ahead, halo])
        div, degree = np.zeros(len(u)), np.zeros(len(u))
        for rows, part, starts in block.some(1):
            w = block.w[part]
            if x is not None:
                # the step is 1 / (2 w), so the weight cancels
                gap = x[block.cols[part]] - np.repeat(ahead[rows], np.diff(np.append(starts, len(w))))
                dual[part] = np.clip(dual[part] - np.where(w > 0, gap, gap * w) / 2, -1, 1)
            div[rows], degree[rows] = np.add.reduceat(w * dual[part], starts), np.add.reduceat(w, starts)
        new = np.where(y > 0, y == c + 1, u - 2 * div / np.where(degree > 0, degree, 1))
        return new, 2 * new - u

    if m.count <= 1:

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    block, y = blocks.Block.of(row), np.frombuffer(row["y"], np.float64)
                    u, ahead, dual = np.zeros(len(y)), None, np.zeros(len(block.w))
                    for _ in range(rounds):
                        u, ahead = move(block, y, row["c"], u, ahead, dual, np.zeros(0))
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(np.full(len(u), row["c"], np.int32)), pa.array(u)], ["id", "cls", "u"])

        return cut(static.repartition(k, "c").mapInArrow(solve, "id long, cls int, u double"))

    def step(first: bool, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            block, y, n = blocks.Block.of(row), np.frombuffer(row["y"], np.float64), len(row["y"]) // 8
            got = {q: np.frombuffer(data, np.float64) for q, data in zip(right.column("q").to_pylist(), right.column("data").to_pylist(), strict=True)}
            own = np.zeros(2 * n + len(block.w)) if first else got[block.p].copy()
            halo = np.concatenate([got[q] for q in block.halo[:, 0].tolist()]) if len(block.halo) and not first else np.zeros(int(block.halo[:, 1].sum()))
            dual = own[2 * n :]
            u, ahead = move(block, y, row["c"], own[:n], None if first else own[n : 2 * n], dual, halo)
            out = [(block.p, u if last else np.concatenate([u, ahead, dual]), block.p)]
            if not last:
                out += [(to, ahead[block.rows[block.to_starts[j] : block.to_starts[j + 1]]], block.p) for j, to in enumerate(block.to.tolist())]
            return pa.table({"p": pa.array([o[0] for o in out]), "c": pa.array([row["c"]] * len(out)), "q": pa.array([o[2] for o in out]), "data": pa.array([o[1].tobytes() for o in out], pa.binary())})

        return run

    kind = "p long, c long, q long, data binary"
    state = spark.createDataFrame([], kind)
    for r in range(rounds):
        state = static.groupBy("p", "c").cogroup(state.groupBy("p", "c")).applyInArrow(step(r == 0, r + 1 == rounds), kind)
        if (r + 1) % 4 == 0 or r + 1 == rounds:
            state = cut(state)

    def shown(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = np.frombuffer(left.column("ids")[0].as_py(), np.int64), zip(right.column("c").to_pylist(), right.column("data").to_pylist(), strict=True)
        parts = [pa.table({"id": pa.array(ids), "cls": pa.array(np.full(len(ids), c, np.int32)), "u": pa.array(np.frombuffer(data, np.float64))}) for c, data in found]
        return pa.concat_tables(parts)

    if not rounds:
        return nodes.select(F.col("id").cast("long").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cls"), F.lit(0.0).alias("u"))
    return cut(m.table.select("p", "ids").groupBy("p").cogroup(state.groupBy("p")).applyInArrow(shown, "id long, cls int, u double"))


def sparse_propagation(nodes: DataFrame, edges: DataFrame, train: DataFrame, cols: list[str], rounds: int, every: int = 2) -> DataFrame:
    """So many rounds of sparse label propagation as joins: id and the columns."""
    fixed, duals = [f"k_{c}" for c in cols], [f"d_{c}" for c in cols]
    base = nodes.select("id").join(degrees(nodes, edges), "id").join(_hot(train, cols).toDF("id", *fixed), "id", "left")
    base = cut(base.select("id", F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(1.0).alias("tau"), *fixed))
    state = base.select("id", *[F.lit(0.0).alias(c) for c in cols])
    dual = edges.where("w > 0").select("src", "dst", "w", *[F.lit(0.0).alias(d) for d in duals])
    for i in range(rounds):
        div = dual.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col("w") * F.col(d)).alias(d) for d in duals])
        moved = base.join(state, "id").join(div, "id", "left")
        new = moved.select("id", *[F.coalesce(k, F.col(c) - 2 * F.col("tau") * F.coalesce(d, F.lit(0.0))).alias(c) for k, c, d in zip(fixed, cols, duals, strict=True)], *[F.col(c).alias(f"o_{c}") for c in cols])
        new = cut(new)
        ahead = new.select("id", *[(2 * F.col(c) - F.col(f"o_{c}")).alias(c) for c in cols])
        ends = dual.join(ahead.toDF("src", *[f"i_{c}" for c in cols]), "src").join(ahead.toDF("dst", *[f"j_{c}" for c in cols]), "dst")
        # the step is 1 / (2 w), so the weight cancels
        dual = ends.select("src", "dst", "w", *[F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(d) - (F.col(f"j_{c}") - F.col(f"i_{c}")) / 2)).alias(d) for d, c in zip(duals, cols, strict=True)])
        state = new.select("id", *cols)
        if (i + 1) % every == 0 and i + 1 < rounds:
            dual = cut(dual)
    return state


class GraphNearestNeighbor(Model):
    """The label of the nearest labelled node in graph distance; slowness (row max / its max) ** alpha."""

    similarity = False

    def __init__(self, graph: Graph, distances: DataFrame | None = None, alpha: float = 1.0, **more):
        super().__init__(graph, **more)
        self.distances, self.alpha = distances, alpha

    def _slowness(self) -> DataFrame | float:
        if self.distances is None:
            return 1.0
        m = cut(self.distances.groupBy(F.col("src").alias("id")).agg(F.max("w").alias("m")))
        top = m.agg(F.max("m")).first()[0]
        return m.select("id", F.pow(F.col("m") / top, F.lit(float(self.alpha))).alias("f"))

    def _scores(self, train: DataFrame, k: int) -> DataFrame:
        lengths = self.distances if self.distances is not None else self.graph.edges
        start = train.where("label >= 0").select(F.col("label").cast("int").alias("cls"), "id", F.lit(0.0).alias("g"))
        d = paths.dijkstra_many(lengths, start, ["cls"], self._slowness())
        every = self.graph.nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cls"))
        return every.join(d, ["id", "cls"], "left").select("id", "cls", F.coalesce("d", F.lit(1e300)).alias("u"))

    def nearest(self, train: DataFrame) -> DataFrame:
        """id, label of the closest labelled node (null where none is reached): one multi-source search for all classes."""
        lengths = self.distances if self.distances is not None else self.graph.edges
        d = paths.dijkstra(self.graph.nodes, lengths, train.where("label >= 0").select("id", F.lit(0.0).alias("g")), self._slowness())
        return d.join(train.select(F.col("id").alias("cp"), "label"), "cp", "left").select("id", F.col("label").cast("int").alias("label"))


class _OneVsRest(Model):
    """A boundary-value problem for each class: solved one after the other in numpy, or all in the same joins."""

    def _one(self, g: local.Local, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _local(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        return np.stack([self._one(g, at, (y == c).astype(float)) for c in range(k)], 1)


class AMLE(_OneVsRest):
    def __init__(self, graph: Graph, weighted: bool = False, tol: float = 1e-5, **more):
        super().__init__(graph, **more)
        self.weighted, self.tol = weighted, tol

    in_blocks = True

    def _one(self, g: local.Local, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return nonlinear.amle_local(g, at, value, self.weighted, self.tol)

    def _joins(self, train: DataFrame, cols: list[str]) -> DataFrame:
        return nonlinear.amle_blocks(self.graph.nodes, self.graph.edges, _hot(train, cols), cols, self.weighted, tol=self.tol)


class PLaplace(_OneVsRest):
    def __init__(self, graph: Graph, p: float = 10.0, fast: bool = True, tol: float = 1e-5, **more):
        super().__init__(graph, **more)
        self.p, self.fast, self.tol = p, fast, tol
        self.in_blocks = fast

    def _one(self, g: local.Local, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return nonlinear.plaplace_local(g, at, value, self.p, self.fast, self.tol)

    def _joins(self, train: DataFrame, cols: list[str]) -> DataFrame:
        if self.fast:
            return nonlinear.plaplace_blocks(self.graph.nodes, self.graph.edges, _hot(train, cols), cols, self.p, tol=self.tol)
        return nonlinear.plaplace_joins(self.graph.nodes, self.graph.edges, _hot(train, cols), cols, self.p, self.fast, tol=self.tol)


class PEikonal(_OneVsRest):
    """Distance to each class by the p-eikonal equation.

    Slowness: with a distance matrix (src, dst, w) the distance to a node's furthest neighbour over
    the greatest such, to the power alpha; in a ball graph (d / max d) ** -alpha; else 1.
    """

    similarity = False
    in_blocks = True

    def __init__(self, graph: Graph, p: float = 1.0, alpha: float = 1.0, distances: DataFrame | None = None, ball_graph: bool = False, **more):
        super().__init__(graph, **more)
        self.p, self.alpha, self.distances, self.ball_graph = p, alpha, distances, ball_graph

    def _slowness(self) -> DataFrame | None:
        if self.distances is not None:
            m, power = cut(self.distances.groupBy(F.col("src").alias("id")).agg(F.max("w").alias("m"))), self.alpha
        elif self.ball_graph:
            m, power = self.graph.degrees().select("id", F.greatest("d", F.lit(1e-300)).alias("m")), -self.alpha
        else:
            return None
        top = float(m.agg(F.max("m")).first()[0])
        own = self.graph.nodes.select("id").join(m, "id", "left")
        return own.select("id", F.pow(F.coalesce("m", F.lit(top)) / top, F.lit(float(power))).alias("f"))

    def _local(self, g: local.Local, at: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
        f = self._slowness()
        rhs = np.ones(g.n) if f is None else f.toPandas().set_index("id").reindex(g.ids)["f"].to_numpy(float)
        u = np.stack([nonlinear.peikonal_local(g, at[y == c], np.zeros((y == c).sum()), self.p, rhs) for c in range(k)], 1)
        return np.where(np.isfinite(u), u, 1e300)

    def _joins(self, train: DataFrame, cols: list[str]) -> DataFrame:
        own = train.where("label >= 0").select("id", *[F.when(F.col("label") == c, 0.0).alias(name) for c, name in enumerate(cols)])
        f = self._slowness()
        u = nonlinear.peikonal_blocks(self.graph.nodes, self.graph.edges, own, cols, self.p, 1.0 if f is None else f)
        return u.select("id", *[F.when(F.col(c) == float("inf"), 1e300).otherwise(F.col(c)).alias(c) for c in cols])


class RandomWalk(Model):
    """((1 - a) I + a L_norm) u = Y on the labelled nodes."""

    def __init__(self, graph: Graph, alpha: float = 0.95, tol: float = 1e-6, **more):
        super().__init__(graph, **more)
        self.alpha, self.tol = alpha, tol

    def _scores(self, train: DataFrame, k: int) -> DataFrame:
        nodes, cols = self.graph.nodes, [f"u{c}" for c in range(k)]
        eye = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1 - self.alpha).alias("w"))
        a = laplacian(nodes, self.graph.edges, "normalized").select("src", "dst", (self.alpha * F.col("w")).alias("w")).unionByName(eye).groupBy("src", "dst").agg(F.sum("w").alias("w"))
        b = train.where("label >= 0").select("id", *[F.when(F.col("label") == c, 1.0).otherwise(0.0).alias(cols[c]) for c in range(k)])
        return wide_to_long(linear.conjgrad(nodes, cut(a), b, cols, self.tol, plan=self.plan), cols)


MODELS = {"laplace": Laplace, "poisson": Poisson, "poisson_mbo": PoissonMBO, "volume_mbo": VolumeMBO, "multiclass_mbo": MulticlassMBO, "modularity_mbo": ModularityMBO, "dynamic_label_propagation": DynamicLabelPropagation, "centered_kernel": CenteredKernel, "sparse_label_propagation": SparseLabelPropagation, "graph_nearest_neighbor": GraphNearestNeighbor, "amle": AMLE, "plaplace": PLaplace, "peikonal": PEikonal, "randomwalk": RandomWalk}
