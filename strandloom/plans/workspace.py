"""Settings of a run, the folders of a scene, and what is loaded from them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import association, raster
from ..sources import scene_files, sparse_model
from . import pipelines

#: Where a scene's parts lie below its folder.
PARTS = {
    "sparse_model": "Colmap/sparse",
    "images": "Colmap/images",
    "lines3d": "Line3D++",
    "groundtruth": "Groundtruth",
    "gt_masks": "Groundtruth/GT_Mask",
    "single_masks": "SAM_Mask/Single_Mask",
    "merged_masks": "SAM_Mask/Merged_Mask",
    "stages": "intermediate_outputs",
}


@dataclass(frozen=True)
class Settings:
    """``workspace`` is any folder that Spark can reach, with or without a scheme."""

    workspace: str
    scene: str
    neighbours: int = 10
    method: str = "leiden"

    def __post_init__(self):
        if self.method not in pipelines.METHODS:
            raise ValueError(f"no method {self.method!r}; there are {', '.join(sorted(pipelines.METHODS))}")
        if self.neighbours < 1:
            raise ValueError("at least one neighbour is asked")

    def path(self, part: str) -> str:
        """The folder of one of the parts of the scene."""
        if part not in PARTS:
            raise ValueError(f"no part {part!r}; there are {', '.join(PARTS)}")
        return f"{self.workspace.rstrip('/')}/{self.scene}/{PARTS[part]}"

    @property
    def line_masks(self) -> str:
        return f"{self.path('stages')}/all_line3d_to_mask"

    def clusters(self, method: str | None = None) -> str:
        return f"{self.path('stages')}/lines3d_clusters_{method or self.method}"


class Loaded:
    """The relations of a scene, read when they are asked for; masks are merged once and kept as a stage."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings

    @cached_property
    def model(self) -> dict[str, DataFrame]:
        return sparse_model.load(self.spark, self.settings.path("sparse_model"))

    @cached_property
    def lines(self) -> tuple[DataFrame, DataFrame]:
        return scene_files.read_lines3d(self.spark, f"{self.settings.path('lines3d')}/Line3D++*.txt")

    @cached_property
    def segments(self) -> DataFrame:
        return scene_files.read_segments(self.spark, self.settings.path("lines3d"))

    @cached_property
    def masks(self) -> DataFrame:
        """(cam_id, mask_id, row, c0, c1): the single masks of each image, merged."""

        def merged() -> DataFrame:
            names = self.model["cameras"].select("cam_id", F.col("base_name").alias("img_name"))
            return raster.merged_masks(scene_files.read_single_masks(self.spark, self.settings.path("single_masks")).join(names, "img_name"))

        return scene_files.stage(self.spark, f"{self.settings.path('merged_masks')}/merged_runs", merged)

    def segment_masks(self, height: int, width: int) -> DataFrame:
        """(cam_id, seg_id, mask_id): the mask that most of a segment's pixels lie on."""
        owner = raster.raster_owner(raster.raster_pixels(self.segments, height, width))
        return raster.majority_mask(raster.pixels_on_masks(owner, self.masks), "cam_id", "seg_id", background=False)

    def line_masks(self, height: int, width: int) -> DataFrame:
        """(cam_id, line3d_id, mask_id) of the lines' own segments, kept as a stage."""
        return scene_files.stage(self.spark, self.settings.line_masks, lambda: association.direct_line_mask(self.lines[1], self.segment_masks(height, width)))

    def clusters(self, height: int, width: int) -> DataFrame:
        """(cluster_id, member_id) by the method of the settings, kept as a stage."""
        return scene_files.stage(self.spark, self.settings.clusters(), lambda: pipelines.clusters_by(self.settings.method, self.line_masks(height, width)))
