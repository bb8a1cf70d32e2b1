"""Connected components by alternating large-star and small-star rounds; few pairs take one task instead."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled
from .joins import dealt_join


#: Pairs up to which the lowest partners are sent to every task.
MOST_BROADCAST = 500_000


def _lowest(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, low): each pair with the lowest of u and all its partners; of many pairs, those of a star's centre are dealt out."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count(F.lit(1)).alias("n"))
    if total <= MOST_BROADCAST:
        return pairs.join(F.broadcast(low.select("u", "low")), "u")
    return dealt_join(pairs, low.select("u", "low"), ["u"], total, low.select("u", "n"))


def _round(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _lowest(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
    # every pair now points down, from u to a lower v
    small = _lowest(large, total)
    return small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(small.select("u", F.col("low").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


#: Pairs of whole-number nodes that one task takes instead of rounds.
TASK_PAIRS = 200_000


def lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (u, v): every node but the lowest of its component, and that."""
    ids, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low = code[: len(u)], code[len(u) :], np.arange(len(ids))
    while True:
        least, before = np.minimum(low[a], low[b]), low
        low = low.copy()
        np.minimum.at(low, before[a], least)  # the roots of both ends learn of each other
        np.minimum.at(low, before[b], least)
        low = low[low]
        if (low == before).all():
            break
    below = low < np.arange(len(ids))
    return ids[below], ids[low[below]]


def _lowest_of_all(batches):
    """(u, v) of pairs with u > v: every node but the lowest of its component, with that."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = lowest(*(np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in (0, 1)))
    yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], ["u", "v"])


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of (src, dst); a component is named by its lowest node.

    Rows with a null end are ignored, loops and repeated edges change nothing,
    nodes without an edge are not listed. Each round halves the depth of the
    stars at least, and is kept in the shared folder.
    """
    pairs = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select("u").distinct()
    edges = settled(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    if 0 < before[0] <= TASK_PAIRS and isinstance(edges.schema["u"].dataType, (T.LongType, T.IntegerType)):
        kind = edges.schema["u"].dataType
        edges = settled(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_lowest_of_all, "u long, v long").select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v")))
        before = (0,)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = settled(_round(edges, before[0]))
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    alone = loops.select(F.col("u").alias("node")).join(named.select("node"), "node", "left_anti")
    return named.unionByName(alone.select("node", F.col("node").alias("component")))
