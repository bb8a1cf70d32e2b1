"""Joins that no frequent key gathers in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key from which on it is dealt to several tasks.
HOT_ROWS = 1_000
#: Keys that are dealt at most, which bounds what is broadcast to deal them.
MOST_HOT = 100_000

#: Rows of one task of a shuffle whose rows are counted first, about.
TASK_ROWS = 1_000_000


def spread(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """``rows`` (``total`` of them, about) by keys over as many tasks as keep each near ``TASK_ROWS``, so that no task grows with the input."""
    parts = -(-total // TASK_ROWS)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def dealt(many: DataFrame, few: DataFrame, keys: list[str], total: int, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` with a column _copy to join on too: the rows that ``many`` has of a frequent key are dealt to copies of its rows in ``few``.

    ``total`` is the number of rows of ``many``: a key is dealt from ``total / MOST_HOT`` rows on (``HOT_ROWS`` at least), so
    there are ``MOST_HOT`` such keys at most. ``counts`` (keys, n) saves counting.
    """
    share = max(HOT_ROWS, total // MOST_HOT)
    if total <= share:
        return many.withColumn("_copy", F.lit(0)), few.withColumn("_copy", F.lit(0))
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = F.broadcast(counts.where(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("_copies")))
    rows = many.join(hot, keys, "left").withColumn("_copy", F.pmod(F.xxhash64(*many.columns, F.spark_partition_id()), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    copies = few.join(hot, keys, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return rows, copies


def dealt_join(many: DataFrame, few: DataFrame, keys: list[str], total: int, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few`` on ``keys``, frequent keys dealt out (see ``dealt``). ``how`` is inner or left."""
    if total <= HOT_ROWS:
        return many.join(few, keys, how)
    rows, copies = dealt(many, few, keys, total, counts)
    return rows.join(copies, [*keys, "_copy"], how).drop("_copy")
