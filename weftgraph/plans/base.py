"""What the named queries share: fixtures as DataFrames, and the same as common table expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.fixpoint import cut, delete_folder, ensure_checkpoint_dir
from weftgraph.operators.knn import knn
from weftgraph.operators.weights import knn_weights

K, PER_CLASS = 10, 3
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name, with its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x (array<double>), label of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and the first two coordinates."""
    return points(spark, sf_dir).select("id", F.slice("x", 1, 2).alias("x"))


def neighbours(spark: SparkSession, sf_dir: str, similarity: str = "euclidean") -> DataFrame:
    """Exact at every size, as the SQL of the queries on it states."""
    return knn(points(spark, sf_dir).select("id", "x"), K, similarity, method="exact")


def graph(spark: SparkSession, sf_dir: str, kernel: str = "gaussian") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the symmetric nearest-neighbour graph; the edges are computed once."""
    return points(spark, sf_dir).select("id"), cut(knn_weights(neighbours(spark, sf_dir), kernel))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label of the first points of each class: a stratified training set."""
    w = Window.partitionBy("label").orderBy("id")
    return points(spark, sf_dir).select("id", "label", F.row_number().over(w).alias("r")).where(F.col("r") <= PER_CLASS).select("id", "label")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node function: the first coordinate."""
    return points(spark, sf_dir).select("id", F.col("x")[0].alias("u"))


@contextmanager
def kept(spark: SparkSession, name: str) -> Iterator[str]:
    """A path in the shared folder, deleted afterwards."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete_folder(spark, path)


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


P = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"
NN = f"{P}, nn AS (SELECT a.id AS src, b.id AS dst, list_distance(a.x, b.x) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id)::INTEGER AS rank FROM p a JOIN p b ON a.id <> b.id QUALIFY rank <= {K})"
OWN = f"{NN}, nb AS (SELECT *, max(dist) OVER (PARTITION BY src) AS own FROM nn)"
E0 = f"{OWN}, e0 AS (SELECT src, dst, exp(-4 * dist * dist / (own * own)) AS w FROM nb)"
E = f"{E0}, e AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT * FROM e0 UNION ALL SELECT dst, src, w FROM e0) GROUP BY src, dst)"
D = f"{E}, d AS (SELECT p.id, coalesce(sum(w), 0) AS d FROM p LEFT JOIN e ON p.id = e.src GROUP BY p.id)"
T = f"t AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM p) WHERE r <= {PER_CLASS})"
