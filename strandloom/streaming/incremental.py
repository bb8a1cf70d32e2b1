"""Masks as they arrive: an image is merged again when more of its masks come, and a restart goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import merged_masks

#: Folders that an arrival's runs are kept in by image, so that a later arrival reads only those of its own images.
BUCKETS = 64


def merge_arriving_runs(spark: SparkSession, runs_folder: str, schema: str, out: str, checkpoint: str):
    """Merge each image's (cam_id, mask_id, row, c0, c1) runs from Parquet files as they come; the checkpoint remembers the files.

    Runs are kept beside ``out``. An image of which more arrives is merged again from all of its runs, other images are left
    alone; ``latest`` reads the last version of each, which does not depend on the order of arrival.
    Equal runs count once, and a repeated batch writes its own folders anew.
    """
    kept = f"{out}-runs"

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        own = batch.withColumn("bucket", F.pmod(F.xxhash64("cam_id"), F.lit(BUCKETS)).cast("int"))
        own.write.mode("overwrite").partitionBy("bucket").parquet(f"{kept}/batch={number}")
        here = session.read.schema(f"{schema}, bucket int").parquet(f"{kept}/batch={number}")
        touched = [r.bucket for r in here.select("bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        known = session.read.schema(f"{schema}, batch long, bucket int").parquet(kept)
        known = known.where(F.col("bucket").isin(touched) & (F.col("batch") <= number)).drop("batch", "bucket")
        runs = known.join(here.select("cam_id").distinct(), "cam_id", "left_semi").distinct()
        merged_masks(runs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(runs_folder)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The merged runs of every image as of its last arrival."""
    rows = spark.read.parquet(out)
    return rows.join(rows.groupBy("cam_id").agg(F.max("batch").alias("batch")), ["cam_id", "batch"], "left_semi").drop("batch")
