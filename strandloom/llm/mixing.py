"""Mixing sources to target weights by systematic sampling.

Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share
all words. A source's target stops at ``MOST_COPIES`` times its own words; the
excess goes to the others by weight until none is above (the level ``rate`` with
``target = min(MOST_COPIES * words, rate * weight)``).

Within a source every document expects ``target / words`` copies. Documents
stand in order of size and doc_id; their expected copies are summed from the
front, the source's one offset in [0, 1) is added, and a document is emitted
once for each whole number its share of the line crosses. Standing by size, the
words taken differ from the target by little more than one document.

The running position is global but never gathers a source in one task: rows are
range-partitioned, each task numbers its own rows, and the tasks' totals give
each task its start.

Defined cases: null text has size 0; a source without words has target 0 and
gives nothing; equal rows (ties) are interchangeable and each counts; a null
doc_id sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_PATTERN, fresh, settled, stored, table

MOST_COPIES = 3
SEED = 1


def words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, source_size, target, share, shift): one row for each source.

    The windows run over the table of sources, one row each.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    ranked = ranked.withColumn("weight", ((F.col("rank") - 1) % 3 + 1)).withColumn("most", F.col("source_size") * MOST_COPIES)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    line = ranked.withColumn("most_upto", F.sum("most").over(upto)).withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    line = line.withColumn("total", F.sum("source_size").over(everything))
    # the level if all sources before this one are at their most
    level = (F.col("total") - (F.col("most_upto") - F.col("most"))) / F.col("weight_from")
    line = line.withColumn("rate", F.max(F.when(level * F.col("weight") <= F.col("most"), level)).over(everything))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("rate") * F.col("weight"), F.col("most").cast("double")))
    return line.select(
        "source", "source_size", target.alias("target"),
        F.coalesce(F.try_divide(target, F.col("source_size").cast("double")), F.lit(0.0)).alias("share"),
        (((F.col("rank") * 40503 + F.lit(seed) * 10007) % 65536) / F.lit(65536.0)).alias("shift"),
    )


def _numbered(at: int, names: list[str]):
    """Number the rows of each source as they come; sources stand together in a partition."""

    def run(batches):
        current, count = (), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(at).dictionary_encode()
            index = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            values = [*codes.dictionary.to_pylist(), None]
            cut = np.flatnonzero(np.diff(index)) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(index)]
            place = np.empty(len(index), np.int64)
            for a, b in zip(starts, ends):
                if (values[index[a]],) != current:
                    current, count = (values[index[a]],), 0
                place[a:b] = np.arange(count + 1, count + 1 + b - a)
                count += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names)

    return run


def planned(rows: DataFrame, seed: int = SEED, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows of (source, size, doc_id, ...) with source_size, target and copies; ``ties`` order rows of one doc_id."""
    order = ["source", "size", "doc_id", *ties]
    rows = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    line = Window.partitionBy("source").orderBy("part")  # a row for each task and source
    starts = rows.groupBy("part", "source").agg(F.count(F.lit(1)).alias("here"))
    starts = starts.withColumn("before", F.sum("here").over(line) - F.col("here")).drop("here")
    known = targets(rows, seed)
    plan = starts.join(known, starts.source.eqNullSafe(known.source)).select(starts.part.alias("p"), starts.source.alias("s"), "before", "source_size", "target", "share", "shift")
    schema = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())])
    numbered = rows.mapInArrow(_numbered(rows.columns.index("source"), schema.names), schema)
    joined = numbered.join(plan, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    upto = lambda k: F.floor(k * F.col("share") + F.col("shift"))
    place = F.col("before") + F.col("place")
    return joined.select(*(c for c in rows.columns if c != "part"), "source_size", "target", (upto(place) - upto(place - 1)).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed documents, each as often as the mix takes it, with the columns of ``docs``."""
    rid, copies = fresh(docs, "row_number", "copies")
    kept = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "mixing")
    same = [F.xxhash64("text").alias("h"), F.hash("text").alias("g")]  # rows that even these do not tell apart have one text
    plan = planned(kept.select("source", words(F.col("text")).alias("size"), "doc_id", *same, F.col(rid).alias("rid")), seed, ("h", "g"))
    plan = plan.where("copies > 0").select(F.col("rid").alias(rid), F.col("copies").alias(copies))
    joined = kept.join(plan, rid)
    out = joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*docs.columns)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", words(F.col("text")).alias("size"), "doc_id")
    return planned(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
), w AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 AS most FROM per
), line AS (
  SELECT *,
    CAST(sum(most) OVER (ORDER BY most / weight, rank ROWS UNBOUNDED PRECEDING) - most AS BIGINT) AS most_before,
    CAST(sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_from,
    CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM w
), rated AS (
  SELECT *, max(CASE WHEN (total - most_before) / weight_from * weight <= most THEN (total - most_before) / weight_from END) OVER () AS rate FROM line
), t AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce(rate * weight, CAST(most AS DOUBLE))) AS target,
    (rank * 40503 + 10007) % 65536 / 65536.0::DOUBLE AS shift FROM rated
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END AS share,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(place * share + shift) - floor((place - 1) * share + shift)) AS BIGINT) AS taken
FROM placed
"""
