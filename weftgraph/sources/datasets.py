"""Reading and writing points, graphs, neighbour tables, training sets, CSV and arrays; sampled point clouds."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.fixpoint import folder_exists


def load_points(spark: SparkSession, path: str, labels_only: bool = False) -> DataFrame:
    """id, label and, unless only labels are asked for, x (array<double>); the scan reads no more columns than that."""
    df = spark.read.parquet(path)
    return df.select("id", "label") if labels_only else df.select("id", F.col("x").cast("array<double>").alias("x"), "label")


def save(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write as Parquet; what is there stays unless asked otherwise."""
    df.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, overwrite: bool = False, **about) -> None:
    """A folder with nodes, edges (sorted within partitions by source, for pruning) and what is said about them."""
    mode = "overwrite" if overwrite else "ignore"
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.sortWithinPartitions("src").write.mode(mode).parquet(f"{path}/edges")
    nodes.sparkSession.createDataFrame([(json.dumps(about),)], "about string").write.mode(mode).parquet(f"{path}/about")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    about = spark.read.parquet(f"{path}/about").first()
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), json.loads(about[0]) if about else {}


def load_knn(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """A stored neighbour table (src, dst, dist, rank), or its first k ranks."""
    df = spark.read.parquet(path).select("src", "dst", "dist", "rank")
    return df if k is None else df.where(F.col("rank") <= k)


def _content(df: DataFrame) -> list[int]:
    """Rows of a table and the sum of their hashes: what a stored table was made of."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))).first()
    return [row[0], int(row[1] or 0)]


def _is_there(spark: SparkSession, path: str, about: dict) -> dict | None:
    """What is said about a stored table, if it was made of the same things; it lies beside the table."""
    if not (folder_exists(spark, path) and folder_exists(spark, f"{path}.about")):
        return None
    said = json.loads(spark.read.parquet(f"{path}.about").first()[0])
    return said if all(said.get(k) == v for k, v in about.items()) else None


def _say(spark: SparkSession, path: str, about: dict) -> None:
    spark.createDataFrame([(json.dumps(about),)], "about string").write.mode("overwrite").parquet(f"{path}.about")


def saved_knn(points: DataFrame, k: int, path: str, similarity: str = "euclidean", method: str = "exact", overwrite: bool = False) -> DataFrame:
    """The neighbour table at a path: computed and written there unless one of the same points, similarity and method with that many ranks is there."""
    from weftgraph.operators.knn import knn

    spark = points.sparkSession
    about = {"similarity": similarity, "method": method, "points": _content(points.select("id", "x"))}
    said = None if overwrite else _is_there(spark, path, about)
    if said is None or said["k"] < k:
        knn(points, k, similarity, method).write.mode("overwrite").parquet(path)
        _say(spark, path, about | {"k": k})
    return load_knn(spark, path, k)


def load_training_sets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("trial", "id")


def saved_training_sets(labels: DataFrame, rates, path: str, trials: int = 1, mask: DataFrame | None = None, seed: int = 0, overwrite: bool = False) -> DataFrame:
    """The training sets at a path: drawn and written there unless those of the same labels, rates, trials, mask and seed are there."""
    from weftgraph.operators.trials import training_sets

    spark = labels.sparkSession
    about = {"rates": [float(r) for r in rates] if isinstance(rates, (list, tuple)) else float(rates), "trials": trials, "seed": seed, "labels": _content(labels.select("id", "label")), "mask": _content(mask) if mask is not None else None}
    if overwrite or _is_there(spark, path, about) is None:
        training_sets(labels, rates, trials, mask, seed).write.mode("overwrite").parquet(path)
        _say(spark, path, about)
    return load_training_sets(spark, path)


def read_numeric_csv(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Columns c0, c1, ... (double) of the rows whose first cell has no letters."""
    names = [f"c{i}" for i in range(columns)]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).csv(path)
    return numeric_rows(raw, names)


def numeric_rows(raw: DataFrame, names: list[str]) -> DataFrame:
    return raw.where(~F.col(names[0]).rlike("[A-Za-z]")).select(*[F.col(n).try_cast("double").alias(n) for n in names])


def load_array(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One field of an .npz file on the driver, as rows (id, x array<double>)."""
    with np.load(path) as z:
        a = np.asarray(z[name], float)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(a)), "x": a.reshape(len(a), -1).tolist()}))


def load_image(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (row, col, ch, v in [0, 1]) of image files, decoded by Spark's image source."""
    df = spark.read.format("image").load(path).select("image.*")
    at = df.select("width", "nChannels", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("double") / 255)).alias("k", "v"))
    # the source keeps channels as blue, green, red
    ch = F.when(F.col("nChannels") == 3, 2 - F.col("k") % 3).otherwise(F.col("k") % F.col("nChannels"))
    return at.select(F.floor(F.col("k") / (F.col("width") * F.col("nChannels"))).cast("int").alias("row"), (F.floor(F.col("k") / F.col("nChannels")) % F.col("width")).cast("int").alias("col"), ch.cast("int").alias("ch"), "v")


def _uniform(seed: int):
    """A number in (0, 1) that is a function of the id and the seed, whatever the partitioning."""
    return (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int):
    """A standard normal number by two uniform ones."""
    return F.sqrt(-2 * F.log(_uniform(seed))) * F.cos(2 * F.pi() * _uniform(seed + 1_000_003))


def two_skies(spark: SparkSession, n: int, sigma: float = 0.15, gap: float = 0.64, seed: int = 0) -> DataFrame:
    """id, x, label: two horizontal bands with Gaussian heights, n points in all."""
    label = (F.col("id") % 2).cast("int")
    return spark.range(n).select("id", F.array(_uniform(seed), sigma * _normal(seed + 1) + label * gap).alias("x"), label.alias("label"))


def two_moons(spark: SparkSession, n: int, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """id, x, label: two interleaved half circles."""
    base = spark.range(n).select("id", (F.col("id") % 2).cast("int").alias("label"), (_uniform(seed) * F.pi()).alias("t"), _normal(seed + 1).alias("e"), _normal(seed + 2).alias("f"))
    x = F.when(F.col("label") == 0, F.cos("t")).otherwise(1 - F.cos("t")) + noise * F.col("e")
    y = F.when(F.col("label") == 0, F.sin("t")).otherwise(0.5 - F.sin("t")) + noise * F.col("f")
    return base.select("id", F.array(x, y).alias("x"), "label")


def _accepted(spark: SparkSession, n: int, dims: int, inside, share: float, seed: int) -> DataFrame:
    """n points of a cube of side 2 that a test accepts: enough are drawn at once, by the share that is accepted; short draws are made anew.

    The first n accepted ones are numbered by range partitions, so that no task sees all.
    """
    from weftgraph.operators.calculus import number

    more = 1.3
    while True:
        m = int(n / share * more) + 100
        drawn = spark.range(m).select("id", F.array(*[2 * _uniform(seed + 7 * j) - 1 for j in range(dims)]).alias("x")).where(inside(F.col("x")))
        first = number(drawn).where(F.col("n") < n)
        if first.count() == n:
            return drawn.join(first.select("id"), "id")
        more *= 1.5


def _square(x):
    return F.aggregate(F.transform(x, lambda a: a * a), F.lit(0.0), lambda a, b: a + b)


def rand_ball(spark: SparkSession, n: int, dims: int = 2, seed: int = 0) -> DataFrame:
    """id, x: uniform in the unit ball."""
    import math

    share = math.pi ** (dims / 2) / math.gamma(dims / 2 + 1) / 2**dims
    return _accepted(spark, n, dims, lambda x: _square(x) <= 1, share, seed)


def rand_annulus(spark: SparkSession, n: int, dims: int = 2, inner: float = 0.5, seed: int = 0) -> DataFrame:
    """id, x: uniform between two radii, the outer one 1."""
    import math

    share = math.pi ** (dims / 2) / math.gamma(dims / 2 + 1) / 2**dims * (1 - inner**dims)
    return _accepted(spark, n, dims, lambda x: (_square(x) <= 1) & (_square(x) >= inner * inner), share, seed)


def bean(spark: SparkSession, n: int, h: float = 0.2, seed: int = 0) -> DataFrame:
    """id, x: uniform in a bean: |y| <= 0.4 sqrt(1 - x^2) (1 + h - cos 3x) for x in [-1, 1] and y in [-0.6, 0.6]; h is the bridge's height."""
    x = np.linspace(-1, 1, 20_001)
    share = float(np.minimum(0.4 * np.sqrt(1 - x * x) * (1 + h - np.cos(3 * x)), 0.6).clip(0).mean())
    inside = lambda x: (F.abs(x[1]) <= 0.6) & (F.abs(x[1]) <= 0.4 * F.sqrt(1 - x[0] * x[0]) * (1 + h - F.cos(3 * x[0])))
    return _accepted(spark, n, 2, inside, share, seed)
