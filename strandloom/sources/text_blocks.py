"""Text files whose lines have an order, read in splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["file", "block"]


def block_lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(file, block, at, value): the lines that ``keep`` accepts; ``at`` grows by one a line within a split of a file.

    A split lies in one task, so numbers taken there after the filter are without gaps; files may be of any size.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return (lines if keep is None else lines.where(keep)).withColumn("at", F.monotonically_increasing_id())


def with_totals_before(lines: DataFrame, amount: Column, *keys: str) -> DataFrame:
    """Lines with ``before``: the sum of ``amount`` over the splits before theirs, of their file where ``keys`` names it, else in order of file names.

    Only totals of splits (a row for each) are put in order, never lines.
    """
    totals = lines.groupBy(*KEY).agg(F.sum(amount).alias("total"), F.min("at").alias("low"))
    order = Window.partitionBy(*keys).orderBy(*KEY)
    return lines.join(totals.select(*KEY, "low", (F.sum("total").over(order) - F.col("total")).alias("before")), KEY)
