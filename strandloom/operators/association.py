"""Joins between segments, masks, 3D lines and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import dealt, spread


def segment_to_line(residuals: DataFrame) -> DataFrame:
    """(cam_id, seg_id, line3d_id): the last line that a segment supports."""
    return residuals.groupBy("cam_id", "seg_id").agg(F.max("line3d_id").alias("line3d_id"))


def line_to_segment(residuals: DataFrame) -> DataFrame:
    """(line3d_id, cam_id, seg_id): the last segment of a line in a view."""
    return residuals.groupBy("line3d_id", "cam_id").agg(F.max(F.struct("proj_pos", "seg_id")).alias("last")).select("line3d_id", "cam_id", F.col("last.seg_id").alias("seg_id"))


def neighbour_lists(near: DataFrame) -> DataFrame:
    """(cam_id, near): the neighbours (neighbour_id) of each view in one list."""
    return near.groupBy("cam_id").agg(F.collect_list("neighbour_id").alias("near"))


def met_at_neighbours(rows: DataFrame, near: DataFrame, there: DataFrame, key: str, total: int, counts: DataFrame) -> DataFrame:
    """``rows`` (cam_id, ``key``, ...) joined with the rows of ``there`` (neighbour_id, ``key``, ...) that neighbouring views hold of the same ``key``.

    A row brings the list of its view's neighbours to its key, so it is shuffled once and not once for each neighbour.
    ``counts`` (``key``, n) says how many of the ``total`` rows a key has, at most; those of a frequent key are dealt to several tasks.
    """
    asks = spread(rows, total, "cam_id").join(neighbour_lists(near), "cam_id")
    asks, there = dealt(asks, there, [key], total, counts)
    met = spread(asks, total, key, "_copy").join(spread(there, total, key, "_copy"), [key, "_copy"])
    return met.where(F.array_contains("near", F.col("neighbour_id"))).drop("_copy", "near")


def counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def correspondence(residuals: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(src_cam, src_seg, tgt_cam, tgt_seg): segments of other views on the same 3D line.

    ``pairs`` (src_cam, tgt_cam) keeps to neighbouring views, and then bounds
    the work by the number of neighbours.
    """
    if pairs is None:
        source = segment_to_line(residuals).withColumnsRenamed({"cam_id": "src_cam", "seg_id": "src_seg"})
        target = line_to_segment(residuals).withColumnsRenamed({"cam_id": "tgt_cam", "seg_id": "tgt_seg"})
        out = source.join(target, "line3d_id").where("src_cam <> tgt_cam")
    else:
        total = residuals.count()
        source = segment_to_line(spread(residuals, total, "cam_id")).withColumnRenamed("seg_id", "src_seg")
        target = line_to_segment(spread(residuals, total, "line3d_id")).withColumnsRenamed({"cam_id": "neighbour_id", "seg_id": "tgt_seg"})
        near = pairs.select(F.col("src_cam").alias("cam_id"), F.col("tgt_cam").alias("neighbour_id"))
        out = met_at_neighbours(source, near, target, "line3d_id", total, counted(residuals, "line3d_id"))
        out = out.withColumnsRenamed({"cam_id": "src_cam", "neighbour_id": "tgt_cam"})
    return out.select("src_cam", "src_seg", "tgt_cam", "tgt_seg")


def direct_line_mask(residuals: DataFrame, seg_mask: DataFrame) -> DataFrame:
    """(cam_id, line3d_id, mask_id): the mask of the last matched segment of each line in each view."""
    total, by = residuals.count(), ("cam_id", "seg_id")
    own = spread(seg_mask, total, *by).join(segment_to_line(spread(residuals, total, *by)), [*by])
    return spread(own, total, "cam_id", "line3d_id").groupBy("cam_id", "line3d_id").agg(F.max(F.struct("seg_id", "mask_id")).alias("last")).select("cam_id", "line3d_id", F.col("last.mask_id").alias("mask_id"))


def full_line_mask(direct: DataFrame, projected: DataFrame) -> DataFrame:
    """Direct assignments, and projected ones for (view, line) pairs without any."""
    rest = projected.join(direct.select("cam_id", "line3d_id"), ["cam_id", "line3d_id"], "left_anti")
    return direct.withColumn("how", F.lit("direct")).unionByName(rest.withColumn("how", F.lit("projected")))


def mask_groups(seg_mask: DataFrame) -> DataFrame:
    """(cam_id, mask_id, segments): the segments of each mask, in order."""
    return seg_mask.groupBy("cam_id", "mask_id").agg(F.sort_array(F.collect_set("seg_id")).alias("segments"))


def distinct_masks(seg_mask: DataFrame) -> DataFrame:
    """(cam_id, masks, lowest, highest) of each view."""
    return seg_mask.groupBy("cam_id").agg(F.count_distinct("mask_id").alias("masks"), F.min("mask_id").alias("lowest"), F.max("mask_id").alias("highest"))


def view_overlap(tracks: DataFrame) -> DataFrame:
    """(cam_a, cam_b, matches) over tracks (point3d_id, pos, cam_id).

    Different views count one for each pair of occurrences; a view with itself
    counts ``c * c + c`` for c occurrences in a track. Occurrences are counted
    before the views of a track are paired.
    """
    seen = spread(tracks, tracks.count(), "point3d_id").groupBy("point3d_id", "cam_id").agg(F.count(F.lit(1)).alias("c"))
    total = seen.groupBy("point3d_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    a, b = (seen.select("point3d_id", F.col("cam_id").alias(f"cam_{x}"), F.col("c").alias(f"c_{x}")) for x in "ab")
    pairs = a.join(b, "point3d_id")
    count = F.when(F.col("cam_a") == F.col("cam_b"), F.col("c_a") * F.col("c_a") + F.col("c_a")).otherwise(F.col("c_a") * F.col("c_b"))
    return spread(pairs.select("cam_a", "cam_b", count.alias("m")), total, "cam_a", "cam_b").groupBy("cam_a", "cam_b").agg(F.sum("m").alias("matches"))


def neighbours(overlap: DataFrame, k: int = 10, least: int = 0) -> DataFrame:
    """(cam_id, rank, neighbour_id, matches): the k views with most matches, ties to the smaller id."""
    order = Window.partitionBy("cam_a").orderBy(F.desc("matches"), "cam_b")
    ranked = overlap.where(F.col("matches") > least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("cam_a").alias("cam_id"), "rank", F.col("cam_b").alias("neighbour_id"), "matches")


def common_points(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cam_a, cam_b, point3d_id, xa, ya, xb, yb) for given view pairs; of repeated features the last one counts."""
    total = features.count()
    own = spread(features, total, "cam_id").groupBy("cam_id", "point3d_id").agg(F.max(F.struct("pos", "x", "y")).alias("last"))
    a, b = (own.select("point3d_id", F.col("cam_id").alias(c), F.col("last.x").alias(f"x{s}"), F.col("last.y").alias(f"y{s}")) for s, c in (("a", "cam_id"), ("b", "neighbour_id")))
    near = pairs.select(F.col("cam_a").alias("cam_id"), F.col("cam_b").alias("neighbour_id"))
    met = met_at_neighbours(a, near, b, "point3d_id", total, counted(features, "point3d_id"))
    return met.select(F.col("cam_id").alias("cam_a"), F.col("neighbour_id").alias("cam_b"), "point3d_id", "xa", "ya", "xb", "yb")


def bounding_area(features: DataFrame) -> DataFrame:
    """(cam_id, area) of the box around a view's features."""
    return features.groupBy("cam_id").agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("area"))


def most_frequent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the smallest."""
    counted = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.max(F.struct("n", (-F.col(value)).alias("low"), value)).alias("top")).select(key, F.col(f"top.{value}").alias(value))


def ground_truth(residuals: DataFrame, gt_seg_mask: DataFrame) -> DataFrame:
    """(line3d_id, instance_id): the instance most of a line's segments lie in."""
    rows = residuals.join(gt_seg_mask, ["cam_id", "seg_id"]).select("line3d_id", F.col("mask_id").alias("instance_id"))
    return most_frequent(rows, "line3d_id", "instance_id")
