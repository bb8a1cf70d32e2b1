"""Near-duplicate embeddings by lattice hashing: random projections decoded to points of E8.

A table projects every vector's direction to eight dimensions, divides by a scale and names its cell by the nearest point of
the lattice E8. A row is at home in its own cell and also asks the neighbouring cells (of the 240 nearest
lattice points) that its residual points at most. Rows meet where one asks the other's home.
``plan`` chooses the scale for the number of rows, and as many tables as pairs of just the threshold need to meet with a
probability of ``RECALL`` (measured on random pairs, which the seed fixes); what meets is verified by its cosine in doubles, so no
link is wrong, and pairs nearer than the threshold are missed far more rarely.

Groups of near copies do not emit their pairs. First, rows gather in balls: in the home cells of the first tables, the row of
lowest hash is the leader, and a row joins, of the leaders within half the threshold's angle, the one of lowest hash. Any
two rows of a ball are then within the threshold of each other, so a ball of w rows gives each w - 1 links without
a comparison. From here on, cells hold balls, once each however many of their rows are there. Two balls
that meet are linked as a whole, or not at all, where their centres and radii say so; where they do not, their rows
are compared in blocks of bounded size, and what leaves a task is counts.

Cells with many balls are cut into blocks by hash, and each pair of blocks is a task's work of its own.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing; vectors of different lengths
are never compared; rows that repeat an id are rows of their own, and linked; a null id is no candidate for the smallest id of a
component, and such a row is kept where its component has no id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..operators.joins import dealt_join
from .common import keyed, mixed, settled, stored, table
from .hard_negatives import usable

#: Least probability that two rows of just the threshold meet, neighbouring cells asked in a table, and tables in which leaders are chosen.
RECALL, PROBES, LEADER_TABLES = 0.99, 6, 4
SCALES = [0.4 * 1.12**i for i in range(14)]
#: Rows or balls in one side of a block.
BLOCK_ROWS = 2048
#: What one comparison costs of what sending a row to a cell costs.
CHECK_COST = 0.02
#: Room for rounding in angles; it only sends pairs to the exact comparison.
SLACK = 1e-7


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    return np.array([*whole, *(s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0)])


ROOTS = _roots()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    at = np.abs(off[odd]).argmax(1)
    near[odd, at] += np.where(off[odd, at] >= 0, 1, -1)
    return near


def decoded(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: whole coordinates with an even sum, or all of them shifted by a half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


def asked(x: np.ndarray, home: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes, 8): the neighbouring lattice points nearest to x."""
    chosen = np.argpartition(-((x - home) @ ROOTS.T), probes - 1, 1)[:, :probes]
    return home[:, None] + ROOTS[chosen]


def projection(number: int, d: int) -> np.ndarray:
    return np.random.default_rng((number, d)).normal(size=(d, 8))


def point_keys(points: np.ndarray, number: int, d: int) -> np.ndarray:
    """A 64-bit key of lattice points (last axis) of a table for vectors of length d."""
    key = np.full(points.shape[:-1], mixed(np.array([number * 65536 + d], np.uint64))[0])
    twice = np.rint(2 * points).astype(np.int64).view(np.uint64)
    for i in range(8):
        key = mixed((key ^ twice[..., i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i))
    return key.view(np.int64)


def plan(rows: int, least: float, recall: float = RECALL, probes: int = PROBES) -> tuple[float, int]:
    """(scale, tables) of least cost for so many rows: what is sent to cells, and chance partners there."""
    rng = np.random.default_rng(17)
    a, z = rng.normal(size=(2, 3000, 8))
    b = least * a + (1 - least * least) ** 0.5 * z  # projections of two directions with that cosine
    best = None
    for s in SCALES:
        homes = decoded(a / s), decoded(b / s)
        meets = (homes[0] == homes[1]).all(1)
        for (x, own), other in (((a / s, homes[0]), homes[1]), ((b / s, homes[1]), homes[0])):
            meets |= (asked(x, own, probes) == other[:, None]).all(2).any(1)
        if not meets.any():
            continue
        tables = 1 if meets.all() else max(LEADER_TABLES, ceil(log(1 - recall) / log(1 - meets.mean())))
        chance = rows * s**8 / (4 * pi) ** 4  # rows in a cell, averaged over a normal density
        cost = tables * (1 + probes) * (1 + CHECK_COST * chance)
        if best is None or cost < best[0]:
            best = cost, s, tables
    return best[1], best[2]


def _units(column: pa.Array) -> np.ndarray:
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no square overflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each length in a batch."""
    d = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(d):
        rows = np.flatnonzero(d == length)
        yield rows, _units(batch.column(at).take(pa.array(rows)))


def homes(rows: DataFrame, scale: float, tables: int) -> DataFrame:
    """(key, u): the home cell of every row in every table."""

    def run(batches):
        for batch in batches:
            u = batch.column(0).to_numpy()
            for own, x in _by_length(batch, 1):
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(point_keys(decoded(x @ projection(t, x.shape[1]) / scale), t, x.shape[1])), pa.array(u[own])], ["key", "u"])

    return rows.select("u", "v").mapInArrow(run, "key long, u long")


def listed(rows: DataFrame, scale: float, tables: int, probes: int) -> DataFrame:
    """(key, ball, home): the cells that each row is at home in or asks."""

    def run(batches):
        for batch in batches:
            ball = batch.column(0).to_numpy()
            for own, x in _by_length(batch, 1):
                d = x.shape[1]
                for t in range(tables):
                    p = x @ projection(t, d) / scale
                    home = decoded(p)
                    keys = np.concatenate([point_keys(home, t, d)[:, None], point_keys(asked(p, home, probes), t, d)], 1)
                    at_home = np.zeros(keys.shape, bool)
                    at_home[:, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ball[own], 1 + probes)), pa.array(at_home.ravel())], ["key", "ball", "home"])

    return rows.select("ball", "v").mapInArrow(run, "key long, ball long, home boolean")


def _angles(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the angle between v and w, which are of one length."""
    source = pairs.select(*keep, "v", "w")
    n = len(keep)

    def run(batches):
        for batch in batches:
            cosine = np.zeros(batch.num_rows)
            for own, x in _by_length(batch, n):
                cosine[own] = (x * _units(batch.column(n + 1).take(pa.array(own)))).sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(cosine), pa.array(np.arccos(np.clip(cosine, -1, 1)))], [*keep, "cosine", "angle"])

    schema = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{schema}, cosine double, angle double")


def balls(rows: DataFrame, total: int, scale: float, tables: int, least: float) -> DataFrame:
    """(u, vec_id, v, ball, angle): every row's ball, named by the row in its centre, and its angle to it."""
    cells = settled(homes(rows, scale, min(tables, LEADER_TABLES)))
    lead = F.min(F.struct(F.xxhash64("u").alias("turn"), F.col("u").alias("leader"))).alias("lead")
    leaders = settled(cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), lead).where("n > 1"))
    seen = dealt_join(cells, leaders.select("key", "lead.leader"), ["key"], total * LEADER_TABLES, leaders).where("u <> leader")
    seen = settled(seen.select("u", "leader").distinct())
    own = seen.join(rows.select("u", "v"), "u")
    centres = rows.select(F.col("u").alias("leader"), F.col("v").alias("w"))
    close = _angles(dealt_join(own, centres, ["leader"], seen.count()).where(F.size("v") == F.size("w")), ["u", "leader"]).where(F.col("angle") <= acos(least) / 2 - SLACK)
    best = close.groupBy("u").agg(F.min(F.struct(F.xxhash64("leader").alias("turn"), F.col("leader"), "angle")).alias("best"))
    joined = rows.join(best, "u", "left").withColumn("stays", F.col("best").isNull() | (F.xxhash64("u") < F.col("best.turn")))
    return joined.select("u", "vec_id", "v", F.when(F.col("stays"), F.col("u")).otherwise(F.col("best.leader")).alias("ball"), F.when(F.col("stays"), 0.0).otherwise(F.col("best.angle")).alias("angle"))


def _met(least: float):
    """Rows come by (key, i, j): the balls that ask against those at home there; pairs that may be linked leave."""

    def pairs(a: pa.Table):
        ball, side = a.column("ball").to_numpy(), a.column("asks").to_numpy(zero_copy_only=False)
        radius = a.column("radius").to_numpy()
        code = np.frombuffer(a.column("code").combine_chunks().buffers()[2] or b"", np.int8)
        offset = a.column("code").combine_chunks().offset
        d = len(a.column("code")[0].as_py())
        x = code[offset * d : (offset + len(ball)) * d].reshape(-1, d).astype(np.float32) / np.float32(127)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        room = acos(least) + radius[one][:, None] + radius[two][None]
        # a code is off by at most half a step in each component
        near = x[one] @ x[two].T >= np.cos(np.minimum(room, pi)) - 1.1 * d**0.5 / 127
        i, j = np.nonzero(near & (ball[one][:, None] != ball[two][None]))
        return np.minimum(ball[one[i]], ball[two[j]]), np.maximum(ball[one[i]], ball[two[j]])

    def run(batches):
        for rows in keyed(batches, ["key", "i", "j"]):
            if rows.num_rows > 1:
                a, b = pairs(rows)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _coded(rows: DataFrame) -> DataFrame:
    """The rows with ``code``: the direction in whole steps of 1 / 127, a byte for each component."""
    names = rows.columns
    at = names.index("v")

    def run(batches):
        for batch in batches:
            code = np.empty(batch.num_rows, object)
            for own, x in _by_length(batch, at):
                for i, c in zip(own, np.rint(127 * x).astype(np.int8)):
                    code[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary())], [*names, "code"])

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("code", T.BinaryType())]))


def meeting(members: DataFrame, centres: DataFrame, scale: float, tables: int, least: float, probes: int = PROBES) -> DataFrame:
    """(a, b), a < b: balls that share a cell and may be linked. ``centres`` has ball, v, radius, weight."""
    cells = listed(members.where("not several"), scale, tables, probes)
    shared = listed(members.where("several"), scale, tables, probes).groupBy("key", "ball").agg(F.bool_or("home").alias("home"))
    cells = settled(cells.unionByName(shared))
    sizes = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("at_home")).where("n > 1 and at_home > 0")
    sizes = settled(sizes.select("key", "n", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("asking"), F.ceil(F.col("at_home") / BLOCK_ROWS).cast("int").alias("housed")))
    total = cells.count()
    held = dealt_join(cells, sizes.select("key", "asking", "housed"), ["key"], total, sizes)
    block = lambda of: F.pmod(F.xxhash64("ball"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asks = held.withColumn("i", block("asking")).withColumn("j", every("housed")).select("key", "i", "j", "ball", F.lit(True).alias("asks"))
    home = held.where("home").withColumn("j", block("housed")).withColumn("i", every("asking")).select("key", "i", "j", "ball", F.lit(False).alias("asks"))
    codes = settled(_coded(centres).select("ball", "radius", "code"))
    both = dealt_join(asks.unionByName(home), codes, ["ball"], 2 * total)
    met = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_met(least), "a long, b long")
    return settled(met.distinct())


def _compared(least: float):
    """Rows of one block of a large ball (``far`` false) and of balls that meet it: links of each row, and the balls that hang together."""
    out = pa.schema([("u", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        far = rows.column("far").to_numpy(zero_copy_only=False)
        u, ball = rows.column("u").to_numpy(), rows.column("ball").to_numpy()
        x = _units(rows.column("v").combine_chunks())
        near, other = np.flatnonzero(~far), np.flatnonzero(far)
        if not len(near) or not len(other):
            return out.empty_table()
        linked = x[near] @ x[other].T >= least
        counts = np.concatenate([linked.sum(1), linked.sum(0)])
        who = np.concatenate([u[near], u[other]])
        hangs = np.unique(ball[other[linked.any(0)]])
        some = counts > 0
        none = np.zeros(len(hangs), np.int64)
        first = pa.table([pa.array(who[some]), pa.array(counts[some].astype(np.int64)), pa.nulls(some.sum(), pa.int64()), pa.nulls(some.sum(), pa.int64())], schema=out)
        second = pa.table([pa.nulls(len(hangs), pa.int64()), pa.array(none), pa.array(np.full(len(hangs), ball[near[0]])), pa.array(hangs)], schema=out)
        return pa.concat_tables([first, second])

    return run


def compared(members: DataFrame, open_: DataFrame, weights: DataFrame, least: float) -> DataFrame:
    """(u, links) of rows and (a, b) of balls, for pairs of balls (a the heavier) that centres and radii do not decide."""
    asks = open_.groupBy("a").agg(F.sum("b_weight").alias("rows"), F.max("a_weight").alias("weight"))
    asks = asks.select("a", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("others"), F.ceil(F.col("weight") / BLOCK_ROWS).cast("int").alias("own"))
    asks = settled(asks)
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    total = members.count()
    near = dealt_join(members.withColumnRenamed("ball", "a"), asks, ["a"], total, weights.withColumnsRenamed({"ball": "a", "weight": "n"}).select("a", "n"))
    near = near.withColumn("i", F.pmod(F.xxhash64("u"), "own").cast("int")).withColumn("j", every("others")).select("a", "i", "j", "u", F.col("a").alias("ball"), "v", F.lit(False).alias("far"))
    meets = open_.select("a", F.col("b").alias("ball")).join(asks, "a")
    far = dealt_join(members, meets, ["ball"], total, weights.select("ball", F.col("weight").alias("n")))
    far = far.withColumn("j", F.pmod(F.xxhash64("u"), "others").cast("int")).withColumn("i", every("own")).select("a", "i", "j", "u", "ball", "v", F.lit(True).alias("far"))
    return settled(near.unionByName(far).groupBy("a", "i", "j").applyInArrow(_compared(least), "u long, links long, a long, b long"))


def linked(rows: DataFrame, least: float = 0.9, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, v)."""
    rows = rows.select("vec_id", "v", F.monotonically_increasing_id().alias("u"))
    rows = stored(rows, "lattice")
    fit = settled(rows.where(usable(rows, "v") & F.exists("v", lambda x: x != 0)))
    total = fit.count()
    scale, tables = plan(total, least, recall)
    members = settled(balls(fit, total, scale, tables, least))
    weights = settled(members.groupBy("ball").agg(F.count(F.lit(1)).alias("weight"), F.max("angle").alias("radius"), F.min("vec_id").alias("low")))
    several = settled(weights.where("weight > 1"))
    members = dealt_join(members, several.select("ball", "weight"), ["ball"], total, several.select("ball", F.col("weight").alias("n")), how="left")
    # a row alone in its ball is its own centre
    members = members.withColumn("several", F.col("weight").isNotNull()).withColumn("ball", F.when(F.col("several"), F.col("ball")).otherwise(F.col("u")))
    members = settled(members.select("u", "vec_id", "v", "ball", "several"))
    alone = members.where("not several").select("ball", "v", F.lit(1).cast("long").alias("weight"), F.lit(0.0).alias("radius"), F.col("vec_id").alias("low"))
    centres = settled(alone.unionByName(several.join(fit.select(F.col("u").alias("ball"), "v"), "ball").select("ball", "v", "weight", "radius", "low")))
    pairs = meeting(members, centres, scale, tables, least)
    first, second = (centres.select(F.col("ball").alias(s), F.col("v").alias(x), F.col("weight").alias(f"{s}_weight"), F.col("radius").alias(f"{s}_radius")) for s, x in (("a", "v"), ("b", "w")))
    met = pairs.count()
    both = dealt_join(dealt_join(pairs, first, ["a"], met), second, ["b"], met).where(F.size("v") == F.size("w"))
    judged = _angles(both, ["a", "b", "a_weight", "b_weight", "a_radius", "b_radius"])
    spread, points = F.col("a_radius") + F.col("b_radius"), (F.col("a_weight") == 1) & (F.col("b_weight") == 1)
    fate = F.when(points, F.when(F.col("cosine") >= least, "all").otherwise("none"))
    fate = fate.when(F.col("angle") + spread <= acos(least) - SLACK, "all").when(F.col("angle") - spread > acos(least) + SLACK, "none").otherwise("open")
    judged = settled(judged.select("a", "b", "a_weight", "b_weight", fate.alias("fate")).where("fate <> 'none'"))
    whole = judged.where("fate = 'all'")
    heavier = F.col("a_weight") >= F.col("b_weight")
    turned = [F.when(heavier, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("a_weight", "b_weight"), ("b_weight", "a_weight"))]
    apart = compared(members, judged.where("fate = 'open'").select(*turned), centres.select("ball", "weight"), least)
    other = whole.select(F.col("a").alias("ball"), F.col("b_weight").alias("links")).unionByName(whole.select(F.col("b").alias("ball"), F.col("a_weight").alias("links")))
    edges = whole.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(apart.where("a is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    named = settled(connected_components(edges)).withColumnsRenamed({"node": "ball"})
    known = centres.select("ball", "weight", "low").join(named, "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    known = settled(known.join(other.groupBy("ball").agg(F.sum("links").alias("links")), "ball", "left"))
    lows = known.groupBy("component").agg(F.min("low").alias("component_id"))
    told = dealt_join(known, lows, ["component"], known.count()).select("ball", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.col("weight").alias("n"))
    told = settled(told)
    each = dealt_join(members.select("u", "ball"), told.select("ball", "component_id", "links"), ["ball"], total, told.select("ball", "n"))
    more = apart.where("u is not null").groupBy("u").agg(F.sum("links").alias("more"))
    each = each.join(more, "u", "left").select("u", "component_id", (F.col("links") + F.coalesce("more", F.lit(0))).alias("links"), F.lit(True).alias("judged"))
    out = rows.select("u", "vec_id").join(each, "u", "left").withColumn("component_id", F.when(F.col("judged"), F.col("component_id")).otherwise(F.col("vec_id")))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")))
