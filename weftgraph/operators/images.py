"""Images as pixel tables (row, col, ch, v): patches and mosaics by coordinate arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def image_to_patches(image: DataFrame, height: int, width: int, shape: tuple[int, int, int]) -> DataFrame:
    """patch, x: tiles of an image of a shape (rows, cols, channels), row-major, padded by zeros, flattened row-major (array<double>).

    A tile's pixels are its fixed height * width * channels, so the grouping is bounded.
    """
    rows, cols, chans = shape
    across, down = -(-cols // width), -(-rows // height)
    places = image.select((F.floor(F.col("row") / height) * across + F.floor(F.col("col") / width)).cast("long").alias("patch"), (((F.col("row") % height) * width + F.col("col") % width) * chans + F.col("ch")).cast("int").alias("at"), F.col("v").cast("double").alias("v"))
    filled = places.groupBy("patch").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    every = image.sparkSession.range(across * down).select(F.col("id").alias("patch")).join(filled, "patch", "left")
    return every.select("patch", F.transform(F.sequence(F.lit(0), F.lit(height * width * chans - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x"))


def patches_to_image(patches: DataFrame, height: int, width: int, shape: tuple[int, int, int]) -> DataFrame:
    """The inverse: pixels of the image, padding cropped."""
    rows, cols, chans = shape
    across = -(-cols // width)
    at = patches.select("patch", F.posexplode("x").alias("k", "v"))
    row = F.floor(F.col("patch") / across) * height + F.floor(F.col("k") / (width * chans))
    col = (F.col("patch") % across) * width + F.floor(F.col("k") / chans) % width
    return at.select(row.cast("int").alias("row"), col.cast("int").alias("col"), (F.col("k") % chans).cast("int").alias("ch"), "v").where((F.col("row") < rows) & (F.col("col") < cols))


def image_grid(images: DataFrame, n_rows: int, n_cols: int, height: int, width: int, channels: int = 1, pad: int = 1, normalise: bool = False) -> DataFrame:
    """Mosaic of images (id, x flattened row-major): the first n_rows * n_cols by id, with a margin; pixels (row, col, ch, v).

    ``normalise`` scales each image to [0, 1].
    """
    chosen = images.where(F.col("id").isNotNull()).orderBy("id").limit(n_rows * n_cols)
    order = chosen.groupBy().agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("all")).select(F.posexplode("all").alias("k", "r"))
    x = F.transform("r.x", lambda v: (v - F.array_min("r.x")) / F.when(F.array_max("r.x") > F.array_min("r.x"), F.array_max("r.x") - F.array_min("r.x")).otherwise(1.0)) if normalise else F.col("r.x")
    cells = order.select("k", F.posexplode(x).alias("i", "v"))
    row = F.floor(F.col("k") / n_cols) * (height + pad) + F.floor(F.col("i") / (width * channels))
    col = (F.col("k") % n_cols) * (width + pad) + F.floor(F.col("i") / channels) % width
    return cells.select(row.cast("int").alias("row"), col.cast("int").alias("col"), (F.col("i") % channels).cast("int").alias("ch"), F.col("v").cast("double").alias("v"))
