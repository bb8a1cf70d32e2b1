"""Hard negatives for embedding training, by Fagin's threshold algorithm over blocks of candidates.

An anchor's positives are the rows of its label that score highest with it; a hard negative of a positive is a row
of another label whose score lies in a window below the positive's. Scores are inner products of integers.

Candidates lie in blocks of about ``BLOCK_ROWS`` rows, anchors in groups of ``GROUP_ROWS``; every group meets every block in a
task of its own. A block holds one list for each dimension, its rows sorted by that component. An
anchor reads each list from the end that its own component's sign prefers, a deeper stretch each time; rows not seen
before are scored at once (random access). What no list has shown yet scores at most the threshold, the sum of the
anchor's components times the last values read, so the block is done when the threshold is strictly below each window's
k-th score (rows with an equal score could have a smaller id) or below what the window admits. What the blocks
found is merged per window.

Rows of one label lie in blocks of that label alone once they are more than a block holds, dealt by hash, and share blocks
by a hash of the label otherwise; so positives are looked for in their label's blocks only, and no
label makes a block larger.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; vectors of different
lengths are never compared; of equal scores the smaller id comes first; rows that repeat an id are candidates each, and an
anchor that is repeated returns its rows each time, but is never its own positive; scores beyond 64 bits count as the largest or smallest
64-bit number; an anchor without positives, or without rows in its window, returns nothing; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, table

#: Candidates in a block, and anchors that a task brings to it.
BLOCK_ROWS, GROUP_ROWS = 4096, 2048
#: Labels with blocks of their own at most, which bounds what is broadcast to deal them.
MOST_LARGE = 100_000
#: Shares of the blocks that anchors are sent to separately, at most.
MOST_SLOTS = 256
#: Entries of each list that an anchor reads first; every later stretch doubles what it has read.
FIRST_STRETCH = 32
_LOW, _HIGH = -(2**63), 2**63 - 1


def usable(rows: DataFrame, vector: str) -> Column:
    """Whether the vector has components, all of them finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


class Lists:
    """A block's rows in one sorted list for each dimension."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.order = rows.argsort(0, kind="stable").T.copy()
        self.values = np.take_along_axis(rows, self.order.T, 0).T.copy()
        #: Floats are exact while no sum of products reaches 2**53.
        self.most = float(np.abs(rows).max(initial=0))

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * float(np.abs(anchor).max()) * len(anchor) < 2**53:
            return (self.rows[at] @ anchor).astype(np.int64)
        exact = np.array([[int(x) for x in row] for row in self.rows[at]], object) @ np.array([int(x) for x in anchor], object)
        return np.array([min(max(x, _LOW), _HIGH) for x in exact], np.int64)

    def sought(self, anchor: np.ndarray, allowed: np.ndarray, ids: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the (scores, ids) of the first ``k`` allowed rows that score within it."""
        n, depth = len(self.rows), 0
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, found = ~allowed, [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        while True:
            last, depth = depth, min(n, max(FIRST_STRETCH, 2 * depth))
            fresh = np.zeros(n, bool)
            fresh[self.order[up, n - depth : n - last]] = True
            fresh[self.order[down, last:depth]] = True
            if not len(up) and not len(down):  # an anchor of zeros: all rows score zero
                fresh[:], depth = True, n
            fresh &= ~seen
            seen |= fresh
            at = np.flatnonzero(fresh)
            if len(at):
                scores = self.scores(at, anchor)
                for w, (low, high) in enumerate(windows):
                    own = (scores >= low) & (scores <= high)
                    if own.any():
                        s, i = np.concatenate([found[w][0], scores[own]]), np.concatenate([found[w][1], ids[at[own]]])
                        first = np.lexsort((i, -s.astype(object) if s.min() == _LOW else -s))[:k]
                        found[w] = s[first], i[first]
            if depth == n:
                return found
            # a float sum of d products is off by less than d * 2**-52 of their absolute sum
            parts = np.concatenate([anchor[up] * self.values[up, n - depth], anchor[down] * self.values[down, depth - 1]])
            threshold = parts.sum() + np.abs(parts).sum() * len(parts) * 2.0**-52
            if all(threshold < (max(low, s[-1]) if len(s) == k else low) for (low, _), (s, _) in zip(windows, found)):
                return found


def _lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False)


def _quantised(column: pa.Array, scale: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(scale * flat.reshape(len(column), -1))


def _searched(scale: int, k: int, same: bool):
    """A cogrouped task: one group of anchors in one block."""
    out = pa.schema([("aid", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return out.empty_table()
        ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        lists = Lists(_quantised(rows.column("v").combine_chunks(), scale))
        asks = _quantised(anchors.column("v").combine_chunks(), scale)
        aid, own_id, own_label = (anchors.column(c).to_numpy() for c in ("aid", "vec_id", "label"))
        bounds = anchors.column("windows").to_pylist()
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for i in range(len(asks)):
            allowed = (labels == own_label[i]) & (ids != own_id[i]) if same else labels != own_label[i]
            if not allowed.any():
                continue
            windows = [(x["low"], x["high"]) for x in bounds[i]]
            for w, (scores, found) in enumerate(lists.sought(asks[i], allowed, ids, windows, k)):
                parts[0].append(np.full(len(found), aid[i]))
                parts[1].append(np.full(len(found), w, np.int32))
                parts[2].append(scores)
                parts[3].append(found)
        return pa.table([pa.array(np.concatenate(p) if p else np.zeros(0, np.int64)).cast(f.type) for p, f in zip(parts, out)], schema=out)

    return run


def dealt(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their block, (block, d, alone)): ``alone`` is the label that fills the block, or null where labels share it."""
    counts = settled(rows.groupBy("d", "label").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(block_rows, total // MOST_LARGE)
    large = F.broadcast(counts.where(F.col("n") > share).select("d", "label", F.ceil(F.col("n") / share).cast("int").alias("parts")))
    packs = max(1, -(-total // share))
    part = F.pmod(F.xxhash64("vec_id", "label", "d"), F.coalesce("parts", F.lit(1)))
    name = F.struct("d", F.when(F.col("parts").isNotNull(), F.col("label")).alias("alone"), F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("label"), F.lit(packs))).otherwise(part).alias("part"))
    placed = rows.join(large, ["d", "label"], "left").withColumn("block", F.xxhash64(name)).drop("parts")
    whole = counts.join(large, ["d", "label"], "left").withColumn("vec_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    named = F.struct("d", F.when(F.col("parts").isNotNull(), F.col("label")).alias("alone"), F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("label"), F.lit(packs))).otherwise(F.col("vec_part").cast("long")).alias("part"))
    return placed, settled(whole.select("d", "label", F.xxhash64(named).alias("block"), F.col("parts").isNotNull().alias("alone")))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, scale: int = 256, low: int = 30, high: int = 90, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, v).

    ``v`` is an array of floats or doubles, whose components become floor(scale * x). A negative has another label and
    low * positive_score <= 100 * negative_score <= high * positive_score; the first ``negatives`` of each positive are returned.
    """
    d = F.size("v")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(rows, "v")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v", d.alias("d"))
    placed, blocks = dealt(rows, block_rows)
    placed = settled(placed)
    anchors = placed.where(is_anchor).drop("block")
    groups = max(1, -(-anchors.count() // group_rows))
    anchors = settled(anchors.withColumn("aid", F.monotonically_increasing_id()).withColumn("grp", F.pmod(F.xxhash64("aid"), F.lit(groups)).cast("int")))

    def searched(asks: DataFrame, k: int, same: bool) -> DataFrame:
        """Asks (aid, block, grp, ...) against the rows of their blocks; rows go to the groups that ask for their block."""
        met = asks.select("block", "grp").distinct()
        mine = asks.select(*(F.col(c).alias(c) for c in ("block", "grp", "aid", "vec_id", "label", "v", "windows")))
        rows_of = placed.join(met, "block").select(*(F.col(c).alias(c) for c in ("block", "grp", "vec_id", "label", "v")))
        found = mine.groupBy("block", "grp").cogroup(rows_of.groupBy("block", "grp")).applyInArrow(_searched(scale, k, same), "aid long, w int, score long, vec_id long")
        order = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    every = F.array(F.struct(F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high")))
    firsts = settled(searched(anchors.join(blocks.select("d", "label", "block"), ["d", "label"]).withColumn("windows", every), positives, True))
    # 30 p <= 100 s <= 90 p for whole s; p is widened to decimals so that no product overflows
    bound = lambda share, f: f(F.col("score").cast("decimal(38,0)") * share / 100).cast("decimal(38,0)")
    clipped = lambda c: F.least(F.greatest(c, F.lit(_LOW).cast("decimal(38,0)")), F.lit(_HIGH).cast("decimal(38,0)")).cast("long")
    window = F.struct((F.col("rank") - 1).alias("w"), clipped(bound(low, F.ceil)).alias("low"), clipped(bound(high, F.floor)).alias("high"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = settled(firsts.groupBy("aid").agg(F.sort_array(F.collect_list(window)).alias("windows")))
    others = settled(blocks.groupBy("d", "block").agg(F.bool_or("alone").alias("alone"), F.max("label").alias("only")))
    asks = anchors.join(windows.select("aid", F.transform("windows", lambda x: F.struct(x["low"], x["high"])).alias("windows")), "aid")
    slots = min(MOST_SLOTS, max(1, others.count()))  # anchors and blocks of one length meet in as many tasks
    others = others.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int"))
    asks = asks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).join(others, ["d", "slot"])
    asks = asks.where(~(F.col("alone") & (F.col("only") == F.col("label")))).drop("slot", "alone", "only")
    found = searched(asks, negatives, False)
    named = windows.select("aid", F.explode("windows").alias("x")).select("aid", F.col("x.w").alias("w"), "x.positive_id", "x.positive_score")
    out = found.join(named, ["aid", "w"]).join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("v"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
with kept as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) as bigint) as score
  from kept a join kept b on len(a.q) = len(b.q) and a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as integer) as rank,
  s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id
where not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 10
"""
