"""Training sets, accuracies, trial statistics and tables."""

from __future__ import annotations

import copy
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.fixpoint import cut, delete_folder, folder_exists


def training_sets(labels: DataFrame, rates: Sequence[int | float] | Sequence[Sequence[int | float]], trials: int = 1, mask: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """trial, id: for each rate and trial a stratified sample without replacement.

    A rate is a number of labels per class, or below 1 a share of the class, or one such number for
    each class.  A node's place in a class is by the MD5 of "id:trial:seed", the same on any
    partitioning and in any database.
    """
    pool = labels.where("label >= 0").select("id", F.col("label").cast("int").alias("label"))
    if mask is not None:
        pool = pool.join(mask.select("id"), "id", "left_semi")
    runs = [(r * trials + t, r) for r in range(len(rates)) for t in range(trials)]
    keyed = pool.select("id", "label", F.explode(F.array(*[F.struct(F.lit(t).cast("int").alias("trial"), F.lit(r).alias("rate")) for t, r in runs])).alias("x")).select("id", "label", "x.trial", "x.rate")
    by = Window.partitionBy("trial", "label")
    ranked = keyed.withColumn("k", F.row_number().over(by.orderBy(F.md5(F.concat_ws(":", "id", "trial", F.lit(seed)).cast("binary")), "id"))).withColumn("size", F.count("*").over(by))

    def number(rate):
        one = lambda x: F.lit(int(x)) if x >= 1 else F.floor(F.col("size") * float(x))
        if isinstance(rate, Iterable):
            return reduce(lambda acc, cx: F.when(F.col("label") == cx[0], one(cx[1])).otherwise(acc), enumerate(rate), F.lit(0))
        return one(rate)

    wanted = reduce(lambda acc, rx: F.when(F.col("rate") == rx[0], number(rx[1])).otherwise(acc), enumerate(rates), F.lit(0))
    return ranked.where(F.col("k") <= wanted).select("trial", "id")


def accuracy(labels: DataFrame, predicted: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """One row (accuracy): percent right off the training set, negative labels left out."""
    rows = predicted.select("id", F.col("label").alias("got")).join(labels.where("label >= 0").select("id", "label"), "id")
    if train is not None:
        rows = rows.join(train.select("id").distinct(), "id", "left_anti")
    return rows.agg((100.0 * F.avg(F.when(F.col("got") == F.col("label"), 1.0).otherwise(0.0))).alias("accuracy"))


def run_trials(model, labels: DataFrame, sets: DataFrame, tag: str = "", path: str | None = None, overwrite: bool = False, parallel: int = 4) -> DataFrame:
    """trial, model, tag, num_train, accuracy for each training set: so many trials at a time, each a run of its own.

    With a path each trial's row is added there when it is done, and trials of this model and tag
    that are there already are left out (or done again and replaced, if asked).
    """
    spark, name = labels.sparkSession, model.name()
    there = f"{path}/{name}{'-' + tag if tag else ''}" if path else None
    if there and overwrite:
        delete_folder(spark, there)
    done = {r.trial for r in load_trials(spark, f"{there}/*").select("trial").collect()} if there and folder_exists(spark, there) else set()
    todo = sorted(r.trial for r in sets.select("trial").distinct().collect() if r.trial not in done)
    schema = "trial int, model string, tag string, num_train int, accuracy double"

    def one(trial: int) -> tuple:
        own = copy.copy(model)  # a fit leaves class weights in its model
        train = cut(labels.join(sets.where(F.col("trial") == trial).select("id"), "id", "left_semi").select("id", "label"))
        row = (trial, name, tag, train.count(), float(accuracy(labels, own.fit_predict(train), train).first()[0]))
        if there:
            spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{there}/run-{trial}")  # of its own, as trials end at the same time
        return row

    if todo and hasattr(model, "prepare"):
        model.prepare()  # what all trials share is made once
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = list(pool.map(one, todo))
    return load_trials(spark, f"{there}/*") if there and (done or rows) else spark.createDataFrame(rows, schema)


def save_trials(results: DataFrame, path: str, overwrite: bool = False) -> None:
    """Results as Parquet; a path that holds results is left as it is unless asked."""
    results.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def trial_statistics(results: DataFrame, by: Sequence[str] = ("num_train",)) -> DataFrame:
    """Mean and population standard deviation of accuracy, and the number of trials."""
    return results.groupBy(*by).agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"), F.count("*").alias("trials"))


def accuracy_ranks(results: DataFrame) -> DataFrame:
    """model, num_train, mean, std, best: whether it has the greatest mean for that number of labels."""
    stats = trial_statistics(results, ("model", "num_train"))
    return stats.select("model", "num_train", "mean", "std", (F.rank().over(Window.partitionBy("num_train").orderBy(F.desc("mean"))) == 1).alias("best"))


def accuracy_table(results: DataFrame, titles: Mapping[str, str] | None = None, digits: int = 1) -> str:
    """LaTeX table of mean (std), the best of each column in bold; as large as models times rates."""
    rows = accuracy_ranks(results).collect()
    rates, models = sorted({r.num_train for r in rows}), sorted({r.model for r in rows})
    cell = {(r.model, r.num_train): (f"\\textbf{{{r.mean:.{digits}f}}}" if r.best else f"{r.mean:.{digits}f}") + f" ({r.std:.{digits}f})" for r in rows}
    lines = ["\\begin{tabular}{l" + "c" * len(rates) + "}", "Labels & " + " & ".join(map(str, rates)) + " \\\\", "\\hline"]
    lines += [" & ".join([(titles or {}).get(m, m), *[cell.get((m, n), "-") for n in rates]]) + " \\\\" for m in models]
    return "\n".join([*lines, "\\end{tabular}"])


def accuracy_curves(results: DataFrame) -> DataFrame:
    """The data of a plot: model, num_train, mean, std, in order."""
    return trial_statistics(results, ("model", "num_train")).orderBy("model", "num_train")


def load_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
