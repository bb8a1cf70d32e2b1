"""Shared folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own (tests) and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    made = spark.sparkContext.getCheckpointDir()
    if not folder and not made and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = made or f"file://{tempfile.mkdtemp(prefix='strandloom-')}"
    if not made:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder; lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed Parquet table in the shared folder, for what is too wide to checkpoint as rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
