"""Graph clustering and its scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import blocks, linear, local
from weftgraph.operators.calculus import degrees
from weftgraph.operators.fixpoint import cut, forget, release


def _labels(spark, g: local.Local, y: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"id": g.ids, "cluster": y.astype(np.int32)}))


def spectral(nodes: DataFrame, edges: DataFrame, k: int, method: str = "NgJordanWeiss", extra_dim: int = 0, seed: int = 0, plan: str = "auto") -> DataFrame:
    """id, cluster: k-means on eigenvectors: combinatorial, ShiMalik (randomwalk), or NgJordanWeiss (rows of the normalized ones, normalised).

    Eigenvectors come from packed blocks and k-means is Spark's, unless plan is local (numpy).
    """
    kinds = {"combinatorial": "combinatorial", "ShiMalik": "randomwalk", "NgJordanWeiss": "normalized"}
    if method not in kinds:
        raise ValueError(f"method is one of {', '.join(kinds)}")
    if plan != "local":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        _, v = linear.eigen_decomp(nodes, edges, k + extra_dim, kinds[method])
        x = F.array(*v.columns[1:])
        length = F.greatest(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, a: s + a * a)), F.lit(1e-300))
        rows = v.select("id", array_to_vector(F.transform(x, lambda a: a / length) if method == "NgJordanWeiss" else x).alias("features"))
        rows = cut(rows.select("id", "features"))
        found = min((KMeans(k=k, seed=seed + i, maxIter=100).fit(rows) for i in range(3)), key=lambda m: m.summary.trainingCost)
        return found.transform(rows).select("id", F.col("prediction").cast("int").alias("cluster"))
    g = local.gather(nodes, edges)
    _, v = linear.eigen_local(g, k + extra_dim, kinds[method])
    if method == "NgJordanWeiss":
        v = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
    return _labels(nodes.sparkSession, g, local.kmeans(v, k, seed))


def _expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling, a Taylor polynomial, and squaring."""
    squarings = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-300)))) + 4)
    b, out, term = a / 2.0**squarings, np.eye(len(a)), np.eye(len(a))
    for j in range(1, 14):
        term = term @ b / j
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


def fokker_planck(nodes: DataFrame, edges: DataFrame, k: int, t: float = 1.0, beta: float = 0.5, rho: DataFrame | None = None, seed: int = 0, width: int = 64, plan: str = "auto") -> DataFrame:
    """id, cluster: k-means on the rows of expm(Q t), Q mixing mean shift to higher density rho (beta; the same everywhere unless given as id, rho) and the Coifman-Lafon diffusion (1 - beta).

    The matrix of all pairs isn't made: its rows are multiplied by ``width`` columns of signs that are a
    function of the id, which keeps their distances, by the exponential's action on packed blocks.  plan
    "local": the dense exponential, in numpy, of a graph of checked size.
    """
    q = generator(nodes, edges, beta, rho)
    if plan == "local":
        g = local.gather(nodes, q)
        return _labels(nodes.sparkSession, g, local.kmeans(_expm(g.dense() * t), k, seed))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    signs = lambda ids: np.sign(blocks.started(ids, width, seed) + 1e-300) / np.sqrt(width)
    m, state = blocks.exponential(nodes, q, t, signs, width)
    names = [f"v{j}" for j in range(width)]
    rows = cut(m.frame(state, np.eye(2 * width)[:, :width], names).select("id", array_to_vector(F.array(*names)).alias("features")))
    found = min((KMeans(k=k, seed=seed + i, maxIter=100).fit(rows) for i in range(3)), key=lambda f: f.summary.trainingCost)
    return found.transform(rows).select("id", F.col("prediction").cast("int").alias("cluster"))


def generator(nodes: DataFrame, edges: DataFrame, beta: float = 0.5, rho: DataFrame | None = None) -> DataFrame:
    """Entries (src, dst, w) of the Fokker-Planck generator; rows sum to 0."""
    d = degrees(nodes, edges).select("id", F.when(F.col("d") > 0, F.col("d")).otherwise(1.0).alias("d"))
    dense = rho.select("id", F.col("rho").cast("double").alias("rho")) if rho is not None else nodes.select("id", F.lit(1.0).alias("rho"))
    about = cut(d.join(dense, "id"))
    e = edges.join(about.toDF("src", "ds", "rs"), "src").join(about.toDF("dst", "dd", "rd"), "dst")
    e = cut(e.select("src", "dst", F.greatest(F.col("w") * (1 / F.col("rs") - 1 / F.col("rd")), F.lit(0.0)).alias("up"), (F.col("w") / F.col("ds") / F.col("dd")).alias("wa")))
    sums = e.groupBy("src").agg(F.sum("up").alias("up_sum"), F.sum("wa").alias("wa_sum"))
    off = e.join(sums, "src").select("src", "dst", (beta * F.col("up") + (1 - beta) * F.when(F.col("wa_sum") > 0, F.col("wa") / F.col("wa_sum")).otherwise(0.0)).alias("w"))
    own = nodes.select(F.col("id").alias("src")).join(sums, "src", "left").select("src", F.col("src").alias("dst"), (-beta * F.coalesce("up_sum", F.lit(0.0)) - F.lit(1 - beta)).alias("w"))
    return cut(off.unionByName(own).groupBy("src", "dst").agg(F.sum("w").alias("w")))


#: Bits of a draw's key that each pass over the keys settles, of 53.
KEY_BITS = (12, 24, 36, 48, 53)


def incres(nodes: DataFrame, edges: DataFrame, k: int, speed: float = 5.0, rounds: int = 200, seed: int = 0, entries: int = blocks.ENTRIES) -> DataFrame:
    """id, cluster: plant seeds in each class, grow them by the walk until each class reaches every node, harvest by argmax, plant more; so many rounds.

    The start and the draws are functions of the id: a class plants its nodes of least key (all, if it
    has fewer).  Growth also ends where the reached nodes are those of two steps before: from there on
    they only alternate (a graph in components, or with an even walk).  On packed blocks; a graph of
    one block is clustered where it lies.
    """
    d = degrees(nodes, edges).select(F.col("id").alias("dst"), F.when(F.col("d") > 0, F.col("d")).otherwise(1.0).alias("d"))
    m, n = blocks.Blocks(nodes, cut(edges.join(d, "dst").select("src", "dst", (F.col("w") / F.col("d")).alias("w"))), entries), nodes.count()
    more = max(int(speed * 1e-4 * n / k), 1)
    uniform = lambda ids, r: blocks.started(ids, 1, seed + r)[:, 0] + 0.5
    first = lambda ids: np.minimum(np.floor(uniform(ids, 0) * k), k - 1)[:, None]
    planted = lambda y, key, top: ((y[:, None] == np.arange(k)) & (key[:, None] <= np.asarray(top))).astype(float)
    harvest = lambda y, f: np.where(f.max(1) > 0, f.argmax(1), y)

    if m.count <= 1:

        def solve(block: blocks.Block, own: np.ndarray, halo: np.ndarray) -> np.ndarray:
            y, none = own[:, 0], np.zeros((0, k))
            for r in range(rounds):
                key, seeds = uniform(block.ids, r + 1), 1 + r * more
                of = [np.sort(key[y == c])[:seeds] for c in range(k)]
                f, old, older = planted(y, key, [x[-1] if len(x) else -1.0 for x in of]), None, None
                for _ in range(2 * n):
                    on = f > 0
                    if on.all() or older is not None and (on == older).all():
                        break
                    old, older = on, old
                    f = block.times(f, none)
                y = harvest(y, f)
            return y[:, None].astype(float)

        done = m.steps(m.start(first), [solve], 0)
        return cut(m.frame(done, np.eye(1), ["y"])).select("id", F.col("y").cast("int").alias("cluster"))
    # columns of a state: class, reached two steps before, reached a step before, what has grown
    shift: blocks.Step = lambda block, own, halo: np.concatenate([own[:, :1], own[:, 1 + k : 1 + 2 * k], own[:, -k:] > 0, own[:, -k:]], 1)
    grow: blocks.Step = lambda block, own, halo: np.concatenate([own[:, :-k], block.times(own[:, -k:], halo)], 1)
    state = cut(m.start(lambda ids: np.concatenate([first(ids), np.zeros((len(ids), 3 * k))], 1)))
    for r in range(rounds):
        keyed = cut(m.steps(state, [lambda block, own, halo, r=r: np.stack([harvest(own[:, 0], own[:, -k:]), uniform(block.ids, r + 1)], 1)], 0))
        forget(state)
        top, seeds = _least_keys(keyed, k, 1 + r * more)
        plant: blocks.Step = lambda block, own, halo, top=top: np.concatenate([own[:, :1], np.full((len(own), k), -1.0), 0 * (f := planted(own[:, 0], own[:, 1], top)), f], 1)
        state = cut(m.steps(keyed, [plant], 0))
        forget(keyed)
        full = seeds == n * k
        for step in range(2 * n):
            if full:
                break
            # the first growth has nothing two steps before it, and the seeds a step before
            unknown = step == 0
            go: blocks.Step = lambda block, own, halo, unknown=unknown: np.concatenate([(x := shift(block, own, halo))[:, :1], np.full((len(x), k), -1.0) if unknown else x[:, 1 : 1 + k], x[:, 1 + k :]], 1)
            old, state = state, cut(m.steps(state, [go, grow], k))
            forget(old)
            reached, changed = _reached(state, k)
            full = reached == n * k or changed == 0
        release(nodes.sparkSession)
    done = m.steps(state, [lambda block, own, halo: harvest(own[:, 0], own[:, -k:])[:, None].astype(float)], 0)
    return cut(m.frame(done, np.eye(1), ["y"])).select("id", F.col("y").cast("int").alias("cluster"))


def _reached(state: DataFrame, k: int) -> tuple[int, int]:
    """How many nodes and classes have grown together, and in how many of them that differs from two steps before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = differs = 0
        for b in batches:
            for data in b.column(2):
                x = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, 1 + 3 * k)
                on += int((x[:, -k:] > 0).sum())
                differs += int(((x[:, -k:] > 0) != x[:, 1 : 1 + k]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([on]), pa.array([differs])], ["reached", "differs"])

    return tuple(state.where("p = q").mapInArrow(run, "reached long, differs long").agg(F.sum("reached"), F.sum("differs")).first())


def _least_keys(state: DataFrame, k: int, m: int) -> tuple[list[float], int]:
    """Of a state (class, key) each class's m-th least key (2 if it has no more, -1 if it has none), and how many keys are no greater.

    Bit by bit: a pass counts the keys of a class by their next bits where they can still be the m-th,
    so that the driver sees at most 4,096 counts a class, whatever the number of nodes.
    """
    want, prefix, known, total, before = [m] * k, [0] * k, {}, 0, 0
    for bits in KEY_BITS:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(2):
                    x = np.frombuffer(data.as_buffer(), np.float64).reshape(-1, 2)
                    c, key = x[:, 0].astype(np.int64), (x[:, 1] * (1 << 53)).astype(np.int64)
                    open_ = ~np.isin(c, list(known)) & ((key >> (53 - before)) == np.array(prefix)[c])
                    at, count = np.unique((c[open_] << 53) | (key[open_] >> (53 - bits)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(at >> 53), pa.array(at & ((1 << 53) - 1)), pa.array(count.astype(np.int64))], ["c", "at", "n"])

        counts = state.where("p = q").mapInArrow(run, "c long, at long, n long").groupBy("c", "at").agg(F.sum("n").alias("n")).orderBy("c", "at").collect()
        for c in range(k):
            if c in known:
                continue
            own = [(row["at"], row["n"]) for row in counts if row["c"] == c]
            if bits == KEY_BITS[0] and sum(x for _, x in own) <= m:
                known[c] = 2.0 if own else -1.0
                total += sum(x for _, x in own)
                continue
            for at, count in own:
                if count >= want[c]:
                    if count == want[c] or bits == 53:
                        known[c] = (((at + 1) << (53 - bits)) - 1) / (1 << 53)
                        total += m - want[c] + count
                    prefix[c] = at
                    break
                want[c] -= count
        if len(known) == k:
            break
        before = bits
    return [known[c] for c in range(k)], total


def _splits(values: DataFrame, by: list[str], total: DataFrame) -> DataFrame:
    """Of numbers (``by``, x) the gain of each split: by, x, n1, gain; distinct values in order, by range partitions and their sums.

    Prefix sums run within each partition; what lies in the partitions before it is added from a
    table of a row for each partition, so that no task sees all values.
    """
    counts = values.groupBy(*by, "x").agg(F.count("*").alias("n"))
    parts = counts.repartitionByRange(*by, "x").sortWithinPartitions(*by, "x").withColumn("part", F.spark_partition_id())
    parts = cut(parts)
    inside = Window.partitionBy("part", *by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    sums = parts.groupBy("part", *by).agg(F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("s"))
    ahead = Window.partitionBy(*(by or [F.lit(1)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", *by, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(ahead), F.lit(0.0)).alias("s0"))
    run = parts.select("part", *by, "x", F.sum("n").over(inside).alias("n1"), F.sum(F.col("x") * F.col("n")).over(inside).alias("s1"))
    run = run.join(F.broadcast(before), ["part", *by]).withColumns({"n1": F.col("n1") + F.col("n0"), "s1": F.col("s1") + F.col("s0")})
    run = (run.join(F.broadcast(total), by) if by else run.join(F.broadcast(total), F.lit(True))).where("n1 < N")
    gain = F.col("s1") * F.col("s1") / F.col("n1") + (F.col("S") - F.col("s1")) * (F.col("S") - F.col("s1")) / (F.col("N") - F.col("n1"))
    return run.select(*by, "x", gain.alias("gain"), "N", "S", "Q")


def _best_splits(values: DataFrame, by: list[str]) -> DataFrame:
    """Of numbers (``by``, x) the best split of each: by, w (squares within over all), threshold; ties to the least threshold."""
    total = cut(values.groupBy(*by).agg(F.count("*").alias("N"), F.sum("x").alias("S"), F.sum(F.col("x") * F.col("x")).alias("Q")))
    best = _splits(values, by, total).groupBy(*by).agg(F.max(F.struct("gain", (-F.col("x")).alias("x"))).alias("b"), F.first("N").alias("N"), F.first("S").alias("S"), F.first("Q").alias("Q")).where("b is not null")
    return best.select(*by, ((F.col("Q") - F.col("b.gain")) / (F.col("Q") - F.col("S") * F.col("S") / F.col("N"))).alias("w"), (-F.col("b.x") + 0.0).alias("threshold"))


def withinss(values: DataFrame, col: str = "x") -> DataFrame:
    """Best split of numbers in two by squares within: w (within over total) and threshold (the greatest value of the left part).

    Distinct values are counted first, so equal numbers never straddle a split; no rows without two
    different values.
    """
    return _best_splits(values.select(F.col(col).cast("double").alias("x")).where("x is not null"), [])


def rp1d(points: DataFrame, tries: int = 100, seed: int = 0, at_once: int = 10) -> DataFrame:
    """id, cluster: the best of some random projections (uniform on [0, 1]^d), split in two by squares within, over all points.

    ``at_once`` projections share a pass; each is a sort of its numbers by range.
    """
    dims = points.select(F.size("x")).first()
    ways = np.random.default_rng(seed).uniform(size=(tries, dims[0] if dims else 0))
    height = lambda v: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(a)) for a in v]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    found = []
    for i in range(0, tries, at_once):
        some = points.select(F.posexplode(F.array(*[height(v) for v in ways[i : i + at_once]])).alias("way", "x"))
        found += [(r.w, i + r.way, r.threshold) for r in _best_splits(some, ["way"]).collect() if r.w is not None]
    if not found:  # all points are one
        return points.select("id", F.lit(0).alias("cluster"))
    _, way, threshold = min(found)
    return points.select("id", F.when(height(ways[way]) > float(threshold), 1).otherwise(0).cast("int").alias("cluster"))


def confusion(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, label, n."""
    return clusters.join(labels.where("label >= 0").select("id", F.col("label").cast("int").alias("label")), "id").groupBy("cluster", "label").agg(F.count("*").alias("n"))


def purity(labels: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """In percent: one row for all (purity), and each cluster's own (cluster, purity)."""
    top = confusion(labels, clusters).groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("size"))
    return top.agg((100.0 * F.sum("top") / F.sum("size")).alias("purity")), top.select("cluster", (100.0 * F.col("top") / F.col("size")).alias("purity"))


def clustering_accuracy(labels: DataFrame, clusters: DataFrame) -> float:
    """Percent right under the best matching of clusters to labels (the confusion table is as small as the classes)."""
    rows = confusion(labels, clusters).collect()
    cs, ls = sorted({r.cluster for r in rows}), sorted({r.label for r in rows})
    k = max(len(cs), len(ls))
    m = np.zeros((k, k))
    for r in rows:
        m[cs.index(r.cluster), ls.index(r.label)] = r.n
    return 100.0 * m[np.arange(k), local.hungarian(-m)].sum() / m.sum()
