"""Active learning: acquisition functions, selection of queries, and the learner's loop."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.fixpoint import cut

MEASURES = ("norm", "entropy", "least_confidence", "smallest_margin", "largest_margin", "unc_2norm")


def uncertainty(scores: DataFrame, measure: str = "smallest_margin") -> DataFrame:
    """id, a: uncertainty of a node's class scores (id, cls, u); greater is less certain.

    norm: length of p = softmax(u) less the hot vector of the argmax; entropy: max p - sum
    p log(p + 1e-5); of the scores themselves: least_confidence 1 - max; smallest_margin 1 - (first - second); largest_margin
    1 - (first - last); unc_2norm 1 - length.
    """
    u = scores.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("cls", "u"))).alias("r")).select("id", F.transform("r", lambda x: x["u"]).alias("u"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    down = F.sort_array("u", asc=False)
    e = F.transform("u", lambda x: F.exp(x - F.array_max("u")))
    p = F.transform(e, lambda x: x / total(e))
    if measure == "norm":
        first = F.array_position("u", F.array_max("u"))
        a = F.sqrt(total(F.transform(p, lambda x, i: (x - F.when(i + 1 == first, 1.0).otherwise(0.0)) ** 2)))
    elif measure == "entropy":
        a = F.array_max(p) - total(F.transform(p, lambda x: x * F.log(x + 1e-5)))
    elif measure == "least_confidence":
        a = 1 - F.array_max("u")
    elif measure == "smallest_margin":
        a = 1 - (F.element_at(down, 1) - F.element_at(down, 2))
    elif measure == "largest_margin":
        a = 1 - (F.element_at(down, 1) - F.element_at(down, -1))
    elif measure == "unc_2norm":
        a = 1 - F.sqrt(total(F.transform("u", lambda x: x * x)))
    else:
        raise ValueError(f"measure is one of {', '.join(MEASURES)}")
    return u.select("id", a.alias("a"))


def _kernel(c: DataFrame) -> DataFrame:
    """Of a kernel (i, j, c): id, sq (squared length of its column), s (column sum), d (its diagonal entry)."""
    return c.groupBy(F.col("j").alias("id")).agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("c").alias("s"), F.sum(F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(0.0)).alias("d"))


def _variance(parts: DataFrame, gamma2: float) -> DataFrame:
    return parts.select("id", (F.col("sq") / (gamma2 + F.col("d"))).alias("a"))


def _sigma(parts: DataFrame, gamma2: float) -> DataFrame:
    return parts.select("id", (F.col("s") * F.col("s") / (gamma2 + F.col("d"))).alias("a"))


def _change(parts: DataFrame, scores: DataFrame, measure: str, gamma2: float) -> DataFrame:
    return uncertainty(scores, measure).join(parts, "id").select("id", (F.col("a") * F.sqrt("sq") / (gamma2 + F.col("d"))).alias("a"))


def _change_variance(parts: DataFrame, scores: DataFrame, measure: str, gamma2: float) -> DataFrame:
    return uncertainty(scores, measure).join(parts, "id").select("id", (F.col("a") * F.col("sq") / (gamma2 + F.col("d"))).alias("a"))


def variance(c: DataFrame, gamma2: float = 0.01) -> DataFrame:
    """VOpt: squared length of a column over gamma2 + its diagonal."""
    return _variance(_kernel(c), gamma2)


def sigma(c: DataFrame, gamma2: float = 0.01) -> DataFrame:
    """Sigma-optimality: squared column sum over gamma2 + the diagonal."""
    return _sigma(_kernel(c), gamma2)


def model_change(c: DataFrame, scores: DataFrame, measure: str = "smallest_margin", gamma2: float = 0.01) -> DataFrame:
    """Uncertainty times a column's length over gamma2 + the diagonal."""
    return _change(_kernel(c), scores, measure, gamma2)


def model_change_variance(c: DataFrame, scores: DataFrame, measure: str = "smallest_margin", gamma2: float = 0.01) -> DataFrame:
    """Uncertainty times a column's squared length over gamma2 + the diagonal."""
    return _change_variance(_kernel(c), scores, measure, gamma2)


def downdate(c: DataFrame, k: int, gamma2: float = 0.01) -> DataFrame:
    """The kernel after node k is labelled: C - C_k C_k^T / (gamma2 + C_kk)."""
    column = cut(c.where(F.col("j") == k).select(F.col("i").alias("i"), F.col("c").alias("ci")))
    d = column.where(F.col("i") == k).select(F.col("ci").alias("dk"))
    return c.join(column, "i").join(column.select(F.col("i").alias("j"), F.col("ci").alias("cj")), "j").crossJoin(F.broadcast(d)).select("i", "j", (F.col("c") - F.col("ci") * F.col("cj") / (gamma2 + F.col("dk"))).alias("c"))


class LazyKernel:
    """A sparse kernel (i, j, c) with nodes labelled one by one, without the table of pairs that ``downdate`` fills.

    After m nodes the kernel is C - B B^T; kept are the m thin columns B (an array for each node) and the
    three values of each node that acquisition functions need, which an update corrects: one read of
    the labelled node's column, one aggregate of m + 2 sums and one product with C.
    """

    def __init__(self, c: DataFrame, gamma2: float = 0.01):
        self.c, self.gamma2, self.labelled = c, gamma2, []
        self.state = cut(_kernel(c).withColumn("b", F.array().cast("array<double>")))

    def update(self, k: int) -> None:
        """Label node k, in the kernel as it stands."""
        own = self.state.where(F.col("id") == k).select("b", "d").first()
        if own is None:
            raise ValueError(f"node {k} isn't in the kernel")
        dot = lambda values: sum((F.col("b")[r] * float(x) for r, x in enumerate(values)), F.lit(0.0))
        column = self.c.where(F.col("j") == k).groupBy(F.col("i").alias("id")).agg(F.sum("c").alias("c"))
        x = (F.coalesce("c", F.lit(0.0)) - dot(own.b)) / float(np.sqrt(self.gamma2 + own.d))
        state = cut(self.state.join(column, "id", "left").select("id", "sq", "s", "d", "b", x.alias("x")))
        total, square, *onto = state.agg(F.sum("x"), F.sum(F.col("x") * F.col("x")), *[F.sum(F.col("x") * F.col("b")[r]) for r in range(len(self.labelled))]).first()
        image = self.c.join(state.where("x <> 0").select(F.col("id").alias("i"), "x"), "i").groupBy(F.col("j").alias("id")).agg(F.sum(F.col("c") * F.col("x")).alias("y"))
        y = F.coalesce("y", F.lit(0.0)) - dot(onto)
        self.state = cut(state.join(image, "id", "left").select(
            "id", (F.col("sq") - 2 * F.col("x") * y + F.col("x") * F.col("x") * square).alias("sq"), (F.col("s") - F.col("x") * total).alias("s"),
            (F.col("d") - F.col("x") * F.col("x")).alias("d"), F.concat("b", F.array("x")).alias("b"),
        ))
        self.labelled.append(k)

    def variance(self) -> DataFrame:
        return _variance(self.state, self.gamma2)

    def sigma(self) -> DataFrame:
        return _sigma(self.state, self.gamma2)

    def model_change(self, scores: DataFrame, measure: str = "smallest_margin") -> DataFrame:
        return _change(self.state, scores, measure, self.gamma2)

    def model_change_variance(self, scores: DataFrame, measure: str = "smallest_margin") -> DataFrame:
        return _change_variance(self.state, scores, measure, self.gamma2)


class TruncatedKernel:
    """A kernel V C V^T by a small matrix and a basis (id, v array); acquisition values without the full kernel."""

    def __init__(self, basis: DataFrame, c: np.ndarray, gamma2: float = 0.01):
        self.basis, self.c, self.gamma2 = basis, c, gamma2

    def _apply(self, m: np.ndarray) -> Column:
        rows = [F.array(*[F.lit(float(x)) for x in r]) for r in m]
        return F.array(*[F.aggregate(F.zip_with("v", r, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for r in rows])

    def _parts(self) -> DataFrame:
        """Of each node with its column C v: sq (squared length), s (sum), d (v . C v); for an orthonormal basis sq is that of the full column."""
        cv = self.basis.select("id", "v", self._apply(self.c).alias("cv"))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return cv.select("id", dot("cv", "cv").alias("sq"), F.aggregate("cv", F.lit(0.0), lambda s, x: s + x).alias("s"), dot("v", "cv").alias("d"))

    def variance(self) -> DataFrame:
        return _variance(self._parts(), self.gamma2)

    def sigma(self) -> DataFrame:
        """The squared sum of C v over gamma2 + v . C v, in the coordinates of the basis."""
        return _sigma(self._parts(), self.gamma2)

    def model_change(self, scores: DataFrame, measure: str = "smallest_margin") -> DataFrame:
        return _change(self._parts(), scores, measure, self.gamma2)

    def model_change_variance(self, scores: DataFrame, measure: str = "smallest_margin") -> DataFrame:
        return _change_variance(self._parts(), scores, measure, self.gamma2)

    def update(self, k: int) -> None:
        v = np.array(self.basis.where(F.col("id") == k).first().v, float)
        a = self.c @ v
        self.c = self.c - np.outer(a, a) / (self.gamma2 + v @ a)


def select_queries(values: DataFrame, batch: int = 1, policy: str | Callable[[DataFrame, int], DataFrame] = "max", candidates: DataFrame | None = None, seed: int = 0, scale: float = 1.0) -> DataFrame:
    """id, a of the chosen nodes: the greatest values, or drawn with odds exp(scale a) without replacement (Gumbel keys)."""
    pool = values if candidates is None else values.join(candidates.select("id"), "id", "left_semi")
    if callable(policy):
        return policy(pool, batch)
    if policy == "max":
        return pool.orderBy(F.desc("a"), "id").limit(batch)
    if policy == "prop":
        u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return pool.withColumn("key", scale * F.col("a") - F.log(-F.log(u))).orderBy(F.desc("key"), "id").limit(batch).select("id", "a")
    raise ValueError("policy is max, prop or a function")


class ActiveLearner:
    """fit -> acquire -> select -> update, over a model of ``ssl`` and a function of its scores."""

    def __init__(self, model, train: DataFrame, acquisition: Callable[[DataFrame], DataFrame], policy: str = "max", seed: int = 0):
        self.model, self.train, self.acquisition, self.policy, self.seed = model, train.select("id", "label"), acquisition, policy, seed
        self.scores = cut(model.fit(self.train))

    def select(self, batch: int = 1, candidates: str | DataFrame = "full", share: float = 0.1) -> DataFrame:
        """Nodes to be labelled: among all unlabelled ones, a random share of them, or those given."""
        values = self.acquisition(self.scores).join(self.train.select("id"), "id", "left_anti")
        if isinstance(candidates, str) and candidates == "rand":
            values = values.where(F.pmod(F.xxhash64("id", F.lit(self.seed + 1)), F.lit(1_000_000)) < share * 1_000_000)
        return select_queries(values, batch, self.policy, candidates if isinstance(candidates, DataFrame) else None, self.seed)

    def update(self, labelled: DataFrame) -> None:
        self.train = cut(self.train.unionByName(labelled.select("id", "label")))
        self.scores = cut(self.model.fit(self.train))
