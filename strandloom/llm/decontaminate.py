"""Benchmark decontamination: containment search by size-partitioned MinHash.

Words are runs of letters and digits in lower case; shingles are five words. Each
benchmark item falls into a partition by the power of two of its number of
shingles. The partition fixes how many of the item's smallest shingle hashes (its
bottom-k MinHash sketch) are searched: ``k = floor((1 - t) * largest size) + 3``, or
all of a smaller item. An item that is contained to ``t`` lacks at most
``(1 - t) * n`` shingles, so at least ``k - floor((1 - t) * n)`` of its sketch is in
the document; a document with fewer hits, or with fewer shingles than ``t * n``, is
no candidate. No contained item is missed, since the sketch of the small set is looked up among all
shingles of the long document rather than compared with a sketch of it.

Candidates are verified on the shingles themselves: the share of the item's
different shingles that the document holds must reach ``t``.

The sketches are broadcast only while they are few (they are counted first);
beyond that they are joined by hash. Everything runs on DataFrame functions.

Defined cases: null and empty texts, and texts of fewer than five words, have no
shingle and neither contain nor are contained; repeated rows are found alike and
listed once; a null doc_id or item_id is an id of its own; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, settled, table

SHINGLE = 5
#: Containment threshold in percent, so that it is compared exactly.
PERCENT = 80
MOST_BROADCAST_ROWS = 500_000


def words(text) -> F.Column:
    """The words as an array; project it before shingling, or every shingle would split the text again."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def _each_shingle(w, make, kind: str) -> F.Column:
    """An array with the different results of ``make`` for the place of each shingle."""
    places = F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0)))
    return F.when(F.size(w) >= SHINGLE, F.array_distinct(F.transform(places, make))).otherwise(F.array().cast(f"array<{kind}>"))


def shingle_hashes(w) -> F.Column:
    return _each_shingle(w, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))), "bigint")


def shingle_texts(w) -> F.Column:
    return _each_shingle(w, lambda i: F.concat_ws(" ", F.slice(w, i + 1, SHINGLE)), "string")


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(item_id, item_hash, h, n, need): the searched shingle hashes of each item and the hits it needs."""
    worded = items.select("item_id", F.xxhash64("text").alias("item_hash"), words(F.col("text")).alias("w"))
    hashes = worded.select("item_id", "item_hash", F.array_sort(shingle_hashes(F.col("w"))).alias("hashes")).distinct()
    sized = hashes.withColumn("n", F.size("hashes"))
    part = F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int")  # the size partition: 2**part to 2**(part + 1) - 1 shingles
    largest = F.pow(F.lit(2.0), part + 1) - 1
    k = F.greatest(F.lit(1), F.least(F.col("n"), F.floor(largest * (100 - percent) / 100) + 3)).cast("int")
    lacking = F.floor(F.col("n") * (100 - percent) / F.lit(100)).cast("int")
    return sized.withColumn("k", k).withColumn("need", F.greatest(F.lit(1), F.col("k") - lacking)).select("item_id", "item_hash", "n", "need", F.explode_outer(F.slice(F.col("hashes"), F.lit(1), F.col("k"))).alias("h")).where("h is not null")


def candidates(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, doc_hash, item_id, item_hash) that the sketches cannot rule out."""
    sketch = settled(sketches(items, percent))
    few = sketch.count() <= MOST_BROADCAST_ROWS
    worded = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), words(F.col("text")).alias("w"))
    hashed = worded.select("doc_id", "doc_hash", shingle_hashes(F.col("w")).alias("hashes"))
    shingled = hashed.select("doc_id", "doc_hash", F.size("hashes").alias("doc_n"), F.explode_outer("hashes").alias("h"))  # an inner explode would infer a filter that splits the text again for each shingle
    hits = shingled.join(F.broadcast(sketch) if few else sketch, "h").where(F.col("doc_n") * 100 >= F.col("n") * percent)
    found = hits.groupBy("doc_id", "doc_hash", "item_id", "item_hash").agg(F.count(F.lit(1)).alias("hits"), F.max("need").alias("need"))
    return found.where("hits >= need").select("doc_id", "doc_hash", "item_id", "item_hash")


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, doc_hash, item_id, n_shingles, n_found, containment) of all contained items."""
    found = settled(candidates(docs, items, percent))
    pairs = found.count()
    wanted = found.select(F.col("doc_id").alias("c_doc"), F.col("doc_hash").alias("c_hash")).distinct()
    wanted = F.broadcast(wanted) if pairs <= MOST_BROADCAST_ROWS else wanted
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("doc_hash"))
    own = own.join(wanted, (F.col("doc_hash") == F.col("c_hash")) & F.col("doc_id").eqNullSafe(F.col("c_doc")), "left_semi").distinct()
    own = own.select(F.col("doc_id").alias("d_doc"), F.col("doc_hash").alias("d_hash"), words(F.col("text")).alias("w"))
    own = own.select("d_doc", "d_hash", shingle_texts(F.col("w")).alias("doc_shingles"))
    probe = items.select(F.col("item_id").alias("i_item"), F.xxhash64("text").alias("i_hash"), words(F.col("text")).alias("w"))
    probe = probe.select("i_item", "i_hash", shingle_texts(F.col("w")).alias("item_shingles")).distinct()
    both = found.join(probe, F.col("item_id").eqNullSafe(F.col("i_item")) & (F.col("item_hash") == F.col("i_hash")))
    both = both.join(own, F.col("doc_id").eqNullSafe(F.col("d_doc")) & (F.col("doc_hash") == F.col("d_hash")))
    n, hit = F.size("item_shingles"), F.size(F.array_intersect("item_shingles", "doc_shingles"))
    counted = both.select("doc_id", "doc_hash", "item_id", n.cast("long").alias("n_shingles"), hit.cast("long").alias("n_found"))
    return counted.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent).withColumn("containment", F.col("n_found") / F.col("n_shingles")).distinct()


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that contain no item."""
    doc, hash_, own = fresh(docs, "leak_doc", "leak_hash", "own_hash")
    leaks = settled(contained(docs.select("doc_id", "text"), items, percent).select(F.col("doc_id").alias(doc), F.col("doc_hash").alias(hash_)).distinct())
    leaks = F.broadcast(leaks) if leaks.count() <= MOST_BROADCAST_ROWS else leaks
    rows = docs.withColumn(own, F.xxhash64("text"))
    return rows.join(leaks, (F.col(own) == F.col(hash_)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti").select(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contained(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_shingles", "n_found", "containment")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents
), b AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), bs AS (
  SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id
), f AS (
  SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment FROM f JOIN n USING (item_id) WHERE n_found * 100 >= n_shingles * 80
"""
