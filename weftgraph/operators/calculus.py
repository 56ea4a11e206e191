"""Graph calculus on edges (src, dst, w), nodes (id) and node functions (id, u).

The node table keeps isolated nodes, which edges don't know.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vectors


def nodes_of(edges: DataFrame) -> DataFrame:
    """The nodes that have edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, d: row sums, 0 for isolated nodes."""
    sums = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"))


def degree_power(nodes: DataFrame, edges: DataFrame, p: float = 1.0) -> DataFrame:
    """The diagonal of the degree matrix to a power: id, d."""
    return degrees(nodes, edges).select("id", F.pow("d", F.lit(float(p))).alias("d"))


def subgraph(nodes: DataFrame, edges: DataFrame, keep: DataFrame, relabel: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within ``keep`` (id); relabelled 0, 1, ... in the order of ids if asked."""
    own = nodes.join(keep.select("id"), "id", "left_semi")
    inner = edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "w")
    if not relabel:
        return own, inner
    numbers = number(own)
    inner = inner.join(numbers.select(F.col("id").alias("src"), F.col("n").alias("s")), "src").join(numbers.select(F.col("id").alias("dst"), F.col("n").alias("t")), "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"), "w")
    return numbers.select(F.col("n").alias("id")), inner


def number(nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """id, n: places 0, 1, ... in the order of ids, by range partitions and their sizes (no single task sees all)."""
    parts = nodes.select(F.col(id_col).alias("id")).repartitionByRange(F.col("id")).sortWithinPartitions("id").select("id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
    from weftgraph.operators.fixpoint import cut

    parts = cut(parts)  # partitions must stay as they are between the two uses
    sizes = sorted((r.p, r.n) for r in parts.groupBy("p").agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p], total = total, total + n
    offset = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]) if before else None
    return parts.select("id", (F.col("k") + (F.try_element_at(offset, F.col("p")) if before else F.lit(0))).cast("long").alias("n"))


def neighbors(edges: DataFrame, node: int, weights: bool = False) -> DataFrame:
    found = edges.where((F.col("src") == node) & (F.col("dst") != node) & (F.col("w") != 0))
    return found.select(F.col("dst").alias("id"), *(["w"] if weights else []))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.where("w <> 0").select("src", "dst", F.lit(1.0).alias("w"))


def random_weights(edges: DataFrame, kind: str = "uniform", seed: int = 0) -> DataFrame:
    """Random values on the pattern of the edges: a function of both ids and the seed, the same on any partitioning.

    Numbers are the first 52 bits of the MD5 of "src:dst:seed:which", which any database has.
    """
    u = lambda s: (F.conv(F.substring(F.md5(F.concat_ws(":", "src", "dst", F.lit(seed), F.lit(s)).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    w = u(1) if kind == "uniform" else F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    return edges.select("src", "dst", w.alias("w"))


def _at(edges: DataFrame, u: DataFrame) -> DataFrame:
    """Edges with the values at both ends: us, ud."""
    return edges.join(u.select(F.col("id").alias("src"), F.col("u").alias("us")), "src").join(u.select(F.col("id").alias("dst"), F.col("u").alias("ud")), "dst")


def gradient(edges: DataFrame, u: DataFrame, p: float = 0.0, weighted: bool = False) -> DataFrame:
    """src, dst, v: u at dst less u at src, times w ** p (p = 1 if weighted and p isn't given)."""
    p = 1.0 if weighted and p == 0 else p
    factor = F.pow("w", F.lit(float(p))) if p else F.lit(1.0)
    return _at(edges, u).select("src", "dst", (factor * (F.col("ud") - F.col("us"))).alias("v"))


def divergence(nodes: DataFrame, edges: DataFrame, field: DataFrame, weighted: bool = True) -> DataFrame:
    """id, u: half the sum over j of w_ij (v_ij - v_ji), absent entries being zero."""
    flipped = field.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("v")).alias("v"))
    both = field.select("src", "dst", "v").unionByName(flipped).groupBy("src", "dst").agg(F.sum("v").alias("v"))
    if weighted:
        both = both.join(edges.select("src", "dst", "w"), ["src", "dst"]).select("src", "dst", (F.col("w") * F.col("v")).alias("v"))
    sums = both.groupBy(F.col("src").alias("id")).agg((F.sum("v") / 2).alias("u"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("u", F.lit(0.0)).alias("u"))


def _scaled(edges: DataFrame, scale: DataFrame, left: float, right: float) -> DataFrame:
    """w_ij d_i ** left d_j ** right; scale: id, d."""
    out = edges
    for end, power in (("src", left), ("dst", right)):
        if power:
            out = out.join(scale.select(F.col("id").alias(end), F.col("d").alias(f"d_{end}")), end).withColumn("w", F.col("w") * F.pow(f"d_{end}", F.lit(float(power))))
    return out.select("src", "dst", "w")


def laplacian(nodes: DataFrame, edges: DataFrame, kind: str = "combinatorial", alpha: float = 1.0) -> DataFrame:
    """Entries (src, dst, w) of a graph Laplacian; zeros aren't kept.

    combinatorial D - W; randomwalk I - W/D; normalized I - D^-1/2 W D^-1/2; coifmanlafon: the
    randomwalk Laplacian of D^-alpha W D^-alpha.  A node without edges has a zero row, but 1 on the
    diagonal of the two kinds that have an identity.
    """
    if kind == "coifmanlafon":
        d = degrees(nodes, edges).where("d > 0")
        return laplacian(nodes, _scaled(edges, d, -alpha, -alpha), "randomwalk")
    d = degrees(nodes, edges)
    if kind == "combinatorial":
        diagonal, off = d.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("d").alias("w")), edges
    elif kind in ("randomwalk", "normalized"):
        diagonal = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
        off = _scaled(edges, d.where("d > 0"), -1.0, 0.0) if kind == "randomwalk" else _scaled(edges, d.where("d > 0"), -0.5, -0.5)
    else:
        raise ValueError("kind is combinatorial, randomwalk, normalized or coifmanlafon")
    parts = diagonal.unionByName(off.select("src", "dst", (-F.col("w")).alias("w")))
    return parts.groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w <> 0")


def infinity_laplacian(nodes: DataFrame, edges: DataFrame, u: DataFrame, n: int | None = None) -> DataFrame:
    """id, u: least plus greatest w_ij (u_j - u_i); absent entries count as zero unless a row is full."""
    n = n if n is not None else nodes.count()
    slope = F.col("w") * (F.col("ud") - F.col("us"))
    rows = _at(edges, u).groupBy(F.col("src").alias("id")).agg(F.min(slope).alias("lo"), F.max(slope).alias("hi"), F.count("*").alias("k"))
    full = F.col("k") >= n
    value = F.when(full, F.col("lo") + F.col("hi")).otherwise(F.least("lo", F.lit(0.0)) + F.greatest("hi", F.lit(0.0)))
    return nodes.select("id").join(rows.select("id", value.alias("u")), "id", "left").select("id", F.coalesce("u", F.lit(0.0)).alias("u"))


def reweight_wnll(nodes: DataFrame, edges: DataFrame, train: DataFrame) -> DataFrame:
    """(a_i + a_j) w_ij with a = n / m at the m labelled nodes and 1 elsewhere."""
    n, m = nodes.count(), train.select("id").distinct().count()
    a = nodes.select("id").join(train.select("id", F.lit(n / m).alias("a")).distinct(), "id", "left").select("id", F.coalesce("a", F.lit(1.0)).alias("u"))
    return _at(edges, a).select("src", "dst", ((F.col("us") + F.col("ud")) * F.col("w")).alias("w"))


def reweight_properly(points: DataFrame, edges: DataFrame, train: DataFrame, alpha: float = 2.0, zeta: float = 1e7, r: float = 0.1) -> DataFrame:
    """(g_i + g_j) w_ij with g = 1 + (r / max(distance to the labelled points, r_zeta)) ** alpha.

    The labelled points are a stated query set: they go to every task (their number is checked).
    """
    held = points.join(train.select("id"), "id", "left_semi").select(F.col("x").alias("y"))
    if (m := held.count()) > 100_000:
        raise ValueError(f"{m} labelled points; at most 100000 are sent to every task")
    least = r / (zeta - 1) ** (1 / alpha)
    near = points.crossJoin(F.broadcast(held)).groupBy("id").agg(F.min(vectors.euclidean(F.col("x"), F.col("y"))).alias("d"))
    g = near.select("id", (1 + F.pow(r / F.greatest("d", F.lit(least)), F.lit(float(alpha)))).alias("u"))
    return _at(edges, g).select("src", "dst", ((F.col("us") + F.col("ud")) * F.col("w")).alias("w"))
