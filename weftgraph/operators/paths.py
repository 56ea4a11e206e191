"""Shortest paths by fronts: only nodes whose value has fallen join their edges.

Distances only fall, so a node that hasn't changed since it last told its neighbours has nothing new
to tell them, and leaves.  Without a number of rounds, nodes are told in buckets of distance (delta
stepping): those of the least distances first, so that few are told twice.  The edges are dealt by
source once; what moves in a round is the front.  The least of (distance, source) is pre-aggregated in
each task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.fixpoint import cut, forget

#: Mean edge lengths in a bucket, and tables of improvements that are kept before they are merged.
BUCKET, LAYERS = 8.0, 4


def _least(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy(*keys).agg(F.min(F.struct("d", "cp")).alias("b")).select(*keys, "b.d", "b.cp")


def _relax(edges: DataFrame, boundary: DataFrame, update: Column, rounds: int | None, keys: list[str], max_dist: float | None, stats: dict | None = None) -> DataFrame:
    """Fixpoint of d_j = min(d_j, update(d_i, w_ij, f_i)) from boundary values; keys name a node (and its run).

    With a number of rounds each is that of all nodes at once.  ``stats`` gets the rounds and the rows
    that fronts and edges gave when joined.
    """
    more = [k for k in keys if k != "id"]
    start = cut(_least([boundary.select(*keys, F.col("g").cast("double").alias("d"), F.col("id").alias("cp"))], keys))
    known, waiting, k, joined = [start], start, 0, 0
    delta = BUCKET * float(edges.agg(F.avg(F.abs(F.col("w") * F.col("f")))).first()[0] or 0.0) if rounds is None else float("inf")
    limit = float("-inf")
    while rounds is None or k < rounds:
        first = waiting.agg(F.min("d")).first()[0]
        if first is None:
            break
        limit = max(limit, first + delta) if first > limit else limit
        front = waiting.where(F.col("d") <= limit) if rounds is None else waiting
        reached = front.withColumnRenamed("id", "src").join(edges, "src").select(F.col("dst").alias("id"), *more, update.alias("d"), "cp")
        if stats is not None:
            joined += reached.count()
        if max_dist is not None:
            reached = reached.where(F.col("d") <= max_dist)
        old = _least(known, keys).withColumnsRenamed({"d": "old", "cp": "oldcp"})
        better = cut(_least([reached], keys).join(old, keys, "left").where("old is null or d < old or (d = old and cp < oldcp)").select(*keys, "d", "cp"))
        known.append(better)
        if len(known) > LAYERS:
            merged = cut(_least(known, keys))
            for table in known[:-1]:
                if table is not waiting:
                    forget(table)
            known = [merged]
        waiting = cut(_least([waiting.where(F.col("d") > limit), better], keys)) if rounds is None else better
        k += 1
    if stats is not None:
        stats |= {"rounds": k, "joined": joined}
    return _least(known, keys)


def _with_slowness(edges: DataFrame, f: DataFrame | float, reciprocal: bool) -> DataFrame:
    e = edges.select("src", "dst", (1 / F.col("w") if reciprocal else F.col("w")).alias("w"))
    e = e.withColumn("f", F.lit(float(f))) if not isinstance(f, DataFrame) else e.join(f.select(F.col("id").alias("src"), F.col("f")), "src")
    return e.repartition("src").sortWithinPartitions("src")  # dealt once: a front is brought to them


def dijkstra(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, f: DataFrame | float = 1.0, max_dist: float | None = None, reciprocal: bool = False, rounds: int | None = None, stats: dict | None = None) -> DataFrame:
    """id, d, cp: distance d_j = min over i of d_i + w_ij f_i from boundary values (id, g), and the source that gives it.

    Unreached nodes and those beyond max_dist have an infinite distance and a null source.  f is a
    number or (id, f).
    """
    found = _relax(cut(_with_slowness(edges, f, reciprocal)), boundary, F.col("d") + F.col("w") * F.col("f"), rounds, ["id"], max_dist, stats)
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("d", F.lit(float("inf"))).alias("d"), "cp")


def dijkstra_many(edges: DataFrame, boundary: DataFrame, runs: list[str], f: DataFrame | float = 1.0, reciprocal: bool = False) -> DataFrame:
    """Several searches in one loop: boundary (runs..., id, g) -> runs..., id, d, cp of the nodes reached."""
    return _relax(cut(_with_slowness(edges, f, reciprocal)), boundary, F.col("d") + F.col("w") * F.col("f"), None, [*runs, "id"], None)


def dijkstra_hl(nodes: DataFrame, edges: DataFrame, boundary: DataFrame, f: DataFrame | float = 1.0, max_dist: float | None = None, rounds: int | None = None) -> DataFrame:
    """As dijkstra, with the Hopf-Lax update (f w + sqrt((f w)^2 + 4 d^2)) / 2."""
    fw = F.col("w") * F.col("f")
    found = _relax(cut(_with_slowness(edges, f, False)), boundary, (fw + F.sqrt(fw * fw + 4 * F.col("d") * F.col("d"))) / 2, rounds, ["id"], max_dist)
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("d", F.lit(float("inf"))).alias("d"), "cp")


def distance(nodes: DataFrame, edges: DataFrame, i: int, j: int, path: bool = False):
    """Distance of two nodes with lengths 1 / w; with its path if asked (list of ids; walked back on the driver, one row a step)."""
    start = nodes.where(F.col("id") == i).select("id", F.lit(0.0).alias("g"))
    d = cut(dijkstra(nodes, edges, start, reciprocal=True))
    row = d.where(F.col("id") == j).first()
    if row is None:
        raise ValueError("not a node")
    if not path:
        return row.d
    walk, at = [j], j
    back = cut(edges.join(d.where("cp is not null").select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").groupBy("dst").agg(F.min(F.struct((F.col("ds") + 1 / F.col("w")).alias("total"), "src")).alias("b")).select("dst", "b.src"))
    while at != i and row.d != float("inf"):
        at = back.where(F.col("dst") == at).first().src
        walk.append(at)
    return row.d, walk[::-1] if row.d != float("inf") else []


def distance_matrix(nodes: DataFrame, edges: DataFrame, centered: bool = False, rounds: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """source, id, d: distances with lengths 1 / w from all nodes, or some; centred: -1/2 J T J (T isn't squared).

    The result has a row for each pair that is connected: its size is the feature.
    """
    start = (sources if sources is not None else nodes).select(F.col("id").alias("source"), "id", F.lit(0.0).alias("g"))
    found = _relax(cut(_with_slowness(edges, 1.0, True)), start, F.col("d") + F.col("w") * F.col("f"), rounds, ["source", "id"], None).select("source", "id", "d")
    if not centered:
        return found
    by_row, by_col = found.groupBy("source").agg(F.avg("d").alias("r")), found.groupBy("id").agg(F.avg("d").alias("c"))
    mean = found.agg(F.avg("d").alias("m"))
    return found.join(by_row, "source").join(by_col, "id").crossJoin(F.broadcast(mean)).select("source", "id", (-0.5 * (F.col("d") - F.col("r") - F.col("c") + F.col("m"))).alias("d"))
