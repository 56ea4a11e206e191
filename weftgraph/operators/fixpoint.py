"""Fixpoint loops over DataFrames: lineage is cut in the shared checkpoint folder after each round."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of our own only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftgraph-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def folder_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, wherever Spark keeps it; one that isn't there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and broadcasts of steps that are done, which Spark keeps until the driver's next full collection."""
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without lineage, from files that every executor can read.

    Their size counts as not known.  Spark's own checkpoint keeps the estimate of the plan that is
    cut off, where a join counts as the product of its sides: a number whose digits multiply with
    each round of a loop of joins, until it fills the driver's memory.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows, none = df.checkpoint()._jdf.queryExecution().logical(), spark._jvm.scala.Option.empty()
    plan = rows.copy(rows.output(), rows.rdd(), rows.outputPartitioning(), rows.outputOrdering(), rows.isStreaming(), rows.stream(), spark._jsparkSession, none, none)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` made, when nothing needs them any more; others are left alone."""
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            delete_folder(df.sparkSession, file.get())


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, changed: Callable[[DataFrame, DataFrame], bool] | None = None, every: int = 1) -> DataFrame:
    """Apply ``step`` for so many rounds, or until ``changed(old, new)`` is false.

    Lineage is cut every so many rounds, and always before a test for change.
    """
    for k in range(rounds):
        new = step(state)
        if changed is not None or (k + 1) % every == 0 or k + 1 == rounds:
            new = cut(new)
        if changed is not None and not changed(state, new):
            return new
        state = new
    return state


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """Weakly connected components of the nodes that have edges: id, component (its least id).

    Each round takes the least label among a node's neighbours, and then the label of that label
    (pointer jumping), so the rounds grow with the logarithm of a component's diameter in most
    graphs.  Sums and minima are pre-aggregated: a node with very many edges is one row per task.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    both = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnsRenamed({"u": "v", "label": "near"}), "v").groupBy("u").agg(F.min("near").alias("near"))
        lower = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("jumped"))
        new = cut(lower.join(jump, "label").select("u", "old", F.least("label", "jumped").alias("label")))
        if new.where("label <> old").isEmpty():
            release(edges.sparkSession)
            return new.select(F.col("u").alias("id"), F.col("label").alias("component"))
        labels = new.select("u", "label")
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the component with most nodes (of several, that of the least id), and of all nodes whether they are in it (id, inside)."""
    found = component_labels(edges)
    labels = cut(nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    top = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").first()
    least = top.component if top else None
    mask = labels.select("id", (F.col("component") == F.lit(least)).alias("inside"))
    keep = mask.where("inside").select("id")
    return nodes.join(keep, "id", "left_semi"), edges.join(keep.select(F.col("id").alias("src")), "src", "left_semi"), mask
