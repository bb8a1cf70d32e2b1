"""Rasterised segments, run-length masks and what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import half_even

BACKGROUND = -1


def raster_pixels(segments: DataFrame, height: int, width: int) -> DataFrame:
    """(cam_id, seg_id, row, col) of segments (cam_id, seg_id, y1, x1, y2, x2); pixels outside the image are left out.

    A segment with an unknown end has none. The line takes one pixel for each step along its longer axis; the other axis
    follows in closed form, so no step depends on the one before.
    """
    r0, c0, r1, c1 = (half_even(F.col(c)) for c in ("y1", "x1", "y2", "x2"))
    own = segments.select("cam_id", "seg_id", r0.alias("r0"), c0.alias("c0"), (r1 - r0).alias("dr"), (c1 - c0).alias("dc"))
    own = own.withColumn("n", F.greatest(F.abs("dr"), F.abs("dc"))).withColumn("minor", F.least(F.abs("dr"), F.abs("dc")))
    # only steps whose longer axis lies inside the image: a segment that reaches far out makes no more
    tall = F.abs("dr") > F.abs("dc")
    start, way, last = F.when(tall, F.col("r0")).otherwise(F.col("c0")), F.when(tall, F.col("dr")).otherwise(F.col("dc")), F.when(tall, height - 1).otherwise(width - 1)
    own = own.withColumns({"low": F.greatest(F.lit(0), F.when(way > 0, -start).otherwise(start - last)), "high": F.least("n", F.when(way > 0, last - start).otherwise(start))})
    own = own.where("low <= high").withColumn("minor", F.col("minor").cast("long")).withColumn("i", F.explode(F.sequence("low", "high")))
    n = F.col("n").cast("long")
    k = F.when(n == 0, 0).otherwise(F.expr("(2L * minor * i + n) div (2L * greatest(n, 1))"))
    sign = lambda c: F.when(F.col(c) > 0, 1).otherwise(-1)
    steep = F.abs("dr") > F.abs("dc")
    row = F.col("r0") + sign("dr") * F.when(steep, F.col("i")).otherwise(k)
    col = F.col("c0") + sign("dc") * F.when(steep, k).otherwise(F.col("i"))
    out = own.select("cam_id", "seg_id", row.cast("int").alias("row"), col.cast("int").alias("col"))
    return out.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def raster_owner(pixels: DataFrame) -> DataFrame:
    """(cam_id, row, col, seg_id): the last segment drawn on each pixel."""
    return pixels.groupBy("cam_id", "row", "col").agg(F.max("seg_id").alias("seg_id"))


def pixels_on_masks(pixels: DataFrame, runs: DataFrame) -> DataFrame:
    """Pixels with the mask they lie on, background where on none: equality on the row, range on the run."""
    own = runs.select("cam_id", "row", "c0", "c1", "mask_id")
    joined = pixels.alias("p").join(own.alias("m"), (F.col("p.cam_id") == F.col("m.cam_id")) & (F.col("p.row") == F.col("m.row")) & F.col("p.col").between(F.col("m.c0"), F.col("m.c1")), "left")
    return joined.select("p.*", F.coalesce("m.mask_id", F.lit(BACKGROUND)).alias("mask_id"))


def majority_mask(pixels: DataFrame, *keys: str, background: bool) -> DataFrame:
    """The mask most pixels of each key lie on, ties to the smallest id.

    With ``background``, background competes and a key it wins has no row;
    without, background pixels do not count.
    """
    counted = (pixels if background else pixels.where(F.col("mask_id") != BACKGROUND)).groupBy(*keys, "mask_id").agg(F.count(F.lit(1)).alias("n_px"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("n_px", (-F.col("mask_id")).alias("low"))).alias("top"))
    return best.select(*keys, (-F.col("top.low")).alias("mask_id"), F.col("top.n_px").alias("n_px")).where(F.col("mask_id") != BACKGROUND)


def mask_area(runs: DataFrame) -> DataFrame:
    return runs.groupBy("cam_id", "mask_id").agg(F.sum(F.col("c1") - F.col("c0") + 1).cast("long").alias("area"))


def run_pixels(runs: DataFrame) -> DataFrame:
    return runs.select("cam_id", "mask_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def mask_cover(runs: DataFrame) -> DataFrame:
    """(cam_id, row, col, mask_id): each pixel's mask of largest area, ties to the smallest id."""
    own = run_pixels(runs).join(mask_area(runs), ["cam_id", "mask_id"])
    best = own.groupBy("cam_id", "row", "col").agg(F.max(F.struct("area", (-F.col("mask_id")).alias("low"))).alias("top"))
    return best.select("cam_id", "row", "col", (-F.col("top.low")).alias("mask_id"))


def nearest_pixel(v, source: int, target: int):
    """The source coordinate that a target coordinate shows under nearest-neighbour resizing."""
    return F.least(F.floor(v * source / target), F.lit(source - 1)).cast("int")


def resized(pixels: DataFrame, source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(cam_id, row, col, mask_id) of a (height, width) image shown at another size: only the pixels that show something are made."""

    def shown(name: str, have: int, want: int):
        # target coordinates t with floor(t * have / want) = v
        low = F.ceil(F.col(name) * want / have)
        high = F.when(F.col(name) == have - 1, F.lit(want - 1)).otherwise(F.ceil((F.col(name) + 1) * want / have) - 1)
        return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    out = pixels.withColumn("r", F.explode(shown("row", source[0], target[0]))).withColumn("c", F.explode(shown("col", source[1], target[1])))
    return out.select("cam_id", F.col("r").cast("int").alias("row"), F.col("c").cast("int").alias("col"), "mask_id")


def overridden(pixels: DataFrame, patches: DataFrame, start: int = 1000) -> DataFrame:
    """(cam_id, row, col, mask_id): pixels that patches (cam_id, file, row, col: their black pixels) overwrite.

    Patches get ids from ``start`` in file order; the last one on a pixel wins.
    """
    from pyspark.sql import Window

    files = patches.select("cam_id", "file").distinct()
    files = files.withColumn("new_id", (F.row_number().over(Window.partitionBy("cam_id").orderBy("file")) + start - 1).cast("int"))
    over = patches.join(files, ["cam_id", "file"]).groupBy("cam_id", "row", "col").agg(F.max("new_id").alias("new_id"))
    return pixels.join(over, ["cam_id", "row", "col"], "left").select("cam_id", "row", "col", F.coalesce("new_id", "mask_id").alias("mask_id"))


def extract(pixels: DataFrame, cam_id: int, mask_id: int) -> DataFrame:
    """(row, col) of one mask of one image."""
    return pixels.where((F.col("cam_id") == cam_id) & (F.col("mask_id") == mask_id)).select("row", "col")


def extracts(pixels: DataFrame) -> DataFrame:
    """(cam_id, mask_id, top, bottom, left_, right_, area) of every mask of the merged images."""
    edges = [f(c).alias(n) for c, f, n in (("row", F.min, "top"), ("row", F.max, "bottom"), ("col", F.min, "left_"), ("col", F.max, "right_"))]
    return pixels.groupBy("cam_id", "mask_id").agg(*edges, F.count(F.lit(1)).alias("area"))


def outline(pixels: DataFrame) -> DataFrame:
    """Pixels with a neighbour above, below, left or right that has another id or none."""
    around = pixels.select("cam_id", "mask_id", F.explode(F.array(*(F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in ((0, 1), (1, 0), (0, -1), (-1, 0))))).alias("at"))
    inner = around.groupBy("cam_id", "mask_id", F.col("at.row").alias("row"), F.col("at.col").alias("col")).agg(F.count(F.lit(1)).alias("n")).where("n = 4").drop("n")
    return pixels.join(inner, ["cam_id", "mask_id", "row", "col"], "left_anti")


def merged_masks(runs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(cam_id, mask_id, row, c0, c1): masks merged into one image, largest first.

    A mask that lies to ``threshold`` or more on one merged before is painted with
    that one's id, over everything; else it takes the free pixels. Each
    step depends on those before, within one image, so an image is one group.
    """
    import numpy as np
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        height, width = int(rows.row.max()) + 1, int(rows.c1.max()) + 1
        canvas = np.full((height, width), BACKGROUND, np.int64)
        masks, own = np.unique(rows.mask_id.to_numpy(), return_inverse=True)
        runs_of = np.argsort(own, kind="stable")
        row, c0, c1 = (rows[c].to_numpy()[runs_of] for c in ("row", "c0", "c1"))
        begin = np.searchsorted(own[runs_of], np.arange(len(masks) + 1))
        area = np.add.reduceat(c1.astype(np.int64) - c0 + 1, begin[:-1])
        painted: dict[int, int] = {}  # in the order of painting
        for k in np.lexsort((masks, -area)).tolist():
            m, part = int(masks[k]), slice(begin[k], begin[k + 1])
            top, left = int(row[part].min()), int(c0[part].min())
            window = canvas[top : int(row[part].max()) + 1, left : int(c1[part].max()) + 1]  # a mask touches its own box only
            inside = np.zeros(window.shape, bool)
            for r, a, b in zip((row[part] - top).tolist(), (c0[part] - left).tolist(), (c1[part] - left).tolist()):
                inside[r, a : b + 1] = True
            ids, counts = np.unique(window[inside], return_counts=True)
            # only masks that lie below are asked, not all painted before; the most shared, of equals the first painted
            fit = [(-n, painted[p], p) for p, n in zip(ids.tolist(), counts.tolist()) if p in painted and n / area[k] >= threshold]
            best = min(fit)[2] if fit else next(iter(painted)) if threshold <= 0 and painted else None
            if best is None:
                window[inside & (window == BACKGROUND)] = m
                painted.setdefault(m, len(painted))
            else:
                window[inside] = best
        out = []
        for r in range(height):
            line = canvas[r]
            cut = np.flatnonzero(np.diff(line)) + 1
            for a, b in zip(np.r_[0, cut], np.r_[cut, width]):
                if line[a] != BACKGROUND:
                    out.append((rows.cam_id.iloc[0], int(line[a]), r, int(a), int(b) - 1))
        return pd.DataFrame(out, columns=["cam_id", "mask_id", "row", "c0", "c1"])

    return runs.select("cam_id", "mask_id", "row", "c0", "c1").groupBy("cam_id").applyInPandas(fold, "cam_id long, mask_id long, row int, c0 int, c1 int")
