"""Edges that arrive as a stream: running degrees, and labels that arrive for an active learner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(stream: DataFrame) -> DataFrame:
    """id, d, n of a stream of edges (src, dst, w): state is one row for each node, partly summed before the shuffle."""
    return stream.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"), F.count("*").alias("n"))


def windowed_degrees(stream: DataFrame, time_col: str = "ts", length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """id, window, d of edges with an event time: late edges count up to the watermark, and older windows leave the state."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, length), F.col("src").alias("id")).agg(F.sum("w").alias("d")).select("id", "window", "d")


def feed_labels(stream: DataFrame, learner, on_update: Callable[[DataFrame], None] | None = None):
    """A started query that gives each micro-batch of labels (id, label) to an active learner, which fits anew."""

    def update(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            learner.update(batch)
            if on_update:
                on_update(learner.scores)

    return stream.writeStream.foreachBatch(update).start()
