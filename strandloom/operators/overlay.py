"""Coloured images of masks and lines, as pixels (cam_id, row, col, red, green, blue)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import raster_pixels

#: The grey behind masks, the share of a mask's colour over white and of a fill over the grey.
BACKDROP = 200
MASK_ALPHA = 0.7
FILL_ALPHA = 0.3
RGB = ("red", "green", "blue")


def bright(key: Column) -> list[Column]:
    """A colour for an id, each channel from 50 to 248; ids less than 7 million apart differ."""
    return [(F.pmod(key * step, F.lit(prime)) + 50).cast("int") for step, prime in ((37, 199), (53, 193), (71, 191))]


def apart(key: Column) -> list[Column]:
    """A colour for an id, each channel more than 50 from the backdrop; ids less than 2 million apart differ."""
    return [F.pmod(key * step, F.lit(prime)).cast("int") for step, prime in ((37, 149), (53, 139), (71, 131))]


def canvas(images: DataFrame, height: int, width: int) -> DataFrame:
    """(cam_id, row, col): every pixel of every image."""
    rows = images.select("cam_id").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    return rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def outer_edge(rows, cols):
    """Which pixels of one mask touch what surrounds it, and not only a hole in it: a mask over the pixels given.

    Pixels meet at corners, the surroundings only at sides. Gaps between the runs of a row are joined with
    those of the row above that they overlap; the gap that goes round the mask is where all begins.
    """
    import numpy as np

    own = np.zeros((rows.max() - rows.min() + 3, cols.max() - cols.min() + 3), bool)
    r, c = rows - rows.min() + 1, cols - cols.min() + 1
    own[r, c] = True
    steps = np.diff(np.pad(~own, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (at, low), (_, high) = np.nonzero(steps == 1), np.nonzero(steps == -1)  # gaps [low, high) by row
    root = list(range(len(at)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(at, np.arange(len(own) + 1))
    for y in range(1, len(own)):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if low[i] < high[j] and low[j] < high[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if high[i] < high[j]:
                i += 1
            else:
                j += 1
    outside = np.zeros(own.shape, bool)
    for k in range(len(at)):
        if find(k) == 0:
            outside[at[k], low[k] : high[k]] = True
    return outside[r - 1, c] | outside[r + 1, c] | outside[r, c - 1] | outside[r, c + 1]


def external_outline(pixels: DataFrame) -> DataFrame:
    """(cam_id, mask_id, row, col) of the pixels on the outer outline of each mask; edges of holes are not part of it.

    A group is one mask of one image.
    """
    import pandas as pd

    def edge(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[outer_edge(rows.row.to_numpy(), rows.col.to_numpy())]

    own = pixels.select("cam_id", "mask_id", "row", "col").distinct()
    return own.groupBy("cam_id", "mask_id").applyInPandas(edge, own.schema)


def mask_overlay(pixels: DataFrame, images: DataFrame, height: int, width: int, alpha: float = MASK_ALPHA) -> DataFrame:
    """Masks in colours of their ids over white, the rest grey over white, black outer outlines."""
    lines = external_outline(pixels).select("cam_id", "row", "col").distinct().withColumn("line", F.lit(True))
    rows = canvas(images, height, width).join(pixels.select("cam_id", "row", "col", "mask_id"), ["cam_id", "row", "col"], "left").join(lines, ["cam_id", "row", "col"], "left")
    mixed = [F.floor(F.lit(255 * (1 - alpha)) + F.coalesce(c, F.lit(BACKDROP)) * F.lit(alpha)).cast("int") for c in bright(F.col("mask_id"))]
    return rows.select("cam_id", "row", "col", *(F.when(F.col("line"), 0).otherwise(c).alias(n) for c, n in zip(mixed, RGB)))


def association_overlay(pixels: DataFrame, segments: DataFrame, seg_mask: DataFrame, images: DataFrame, height: int, width: int, alpha: float = FILL_ALPHA) -> DataFrame:
    """Masks that have a segment, filled thinly over grey, and their segments two pixels wide in the mask's full colour.

    Where segments meet the one of the larger id is on top. A segment without mask is not drawn.
    """
    known = seg_mask.select("cam_id", "seg_id", F.col("mask_id").alias("seg_mask")).where("seg_mask <> -1")
    used = known.select("cam_id", F.col("seg_mask").alias("mask_id")).distinct()
    own = segments.join(known, ["cam_id", "seg_id"], "left_semi")
    steep = F.abs(F.bround("y2") - F.bround("y1")) > F.abs(F.bround("x2") - F.bround("x1"))
    wide = own.select("cam_id", "seg_id", steep.alias("steep"))
    drawn = raster_pixels(own, height, width).join(wide, ["cam_id", "seg_id"]).withColumn("more", F.explode(F.array(F.lit(0), F.lit(1))))
    drawn = drawn.select("cam_id", "seg_id", (F.col("row") + F.when(F.col("steep"), 0).otherwise(F.col("more"))).alias("row"), (F.col("col") + F.when(F.col("steep"), F.col("more")).otherwise(0)).alias("col"))
    top = drawn.groupBy("cam_id", "row", "col").agg(F.max("seg_id").alias("seg_id")).join(known, ["cam_id", "seg_id"]).select("cam_id", "row", "col", "seg_mask")
    filled = pixels.select("cam_id", "row", "col", "mask_id").join(used, ["cam_id", "mask_id"], "left_semi")
    rows = canvas(images, height, width).join(filled, ["cam_id", "row", "col"], "left").join(top, ["cam_id", "row", "col"], "left")
    back = [F.bround(BACKDROP * F.lit(1 - alpha) + F.coalesce(c, F.lit(BACKDROP)) * F.lit(alpha)).cast("int") for c in apart(F.col("mask_id"))]
    return rows.select("cam_id", "row", "col", *(F.coalesce(c, b).alias(n) for c, b, n in zip(apart(F.col("seg_mask")), back, RGB)))


def instance_colours(pixels: DataFrame, images: DataFrame, height: int, width: int) -> DataFrame:
    """Instances in colours of their ids over black."""
    rows = canvas(images, height, width).join(pixels.select("cam_id", "row", "col", "mask_id"), ["cam_id", "row", "col"], "left")
    return rows.select("cam_id", "row", "col", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(bright(F.col("mask_id")), RGB)))


def object_names(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """(cam_id, objects, name): how many masks an image shows, and the file name that says so."""
    counts = pixels.groupBy("cam_id").agg(F.countDistinct("mask_id").alias("objects"))
    rows = images.select("cam_id").distinct().join(counts, "cam_id", "left").select("cam_id", F.coalesce("objects", F.lit(0)).alias("objects"))
    return rows.withColumn("name", F.concat(F.col("cam_id").cast("string"), F.lit("_"), F.col("objects").cast("string"), F.lit("objs.png")))
