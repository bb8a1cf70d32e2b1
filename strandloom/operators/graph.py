"""Co-occurrence graphs over 3D lines and their communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled, stored
from . import joins, packed_pairs
from .communities import leiden  # noqa: F401
from .components import connected_components
from .joins import spread


def kept_masks(line_mask: DataFrame) -> DataFrame:
    """(cam_id, mask_id, line3d_id), worked out once and kept, for all steps that ask for a graph, its nodes or its views."""
    return stored(line_mask.select("cam_id", "mask_id", "line3d_id"), "line-masks")


def _shared_masks(kept: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose mask has other lines, and how many pairs these make; a task for each million rows."""
    rows = spread(kept, kept.count(), "cam_id", "mask_id")
    shared = rows.groupBy("cam_id", "mask_id").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    pairs = shared.agg(F.sum(F.expr("lines * (lines - 1) div 2"))).first()[0] or 0
    return rows.join(shared.drop("lines"), ["cam_id", "mask_id"], "left_semi"), pairs


def cooccurrence(line_mask: DataFrame, required_views: int = 1) -> DataFrame:
    """(src, dst, weight): pairs of lines that share a mask in ``required_views`` views or more.

    Lines alone in their mask meet nobody and leave before the join.
    """
    return kept_cooccurrence(kept_masks(line_mask), required_views)


def kept_cooccurrence(kept: DataFrame, required_views: int = 1) -> DataFrame:
    """``cooccurrence`` of rows that ``kept_masks`` has kept."""
    rows, total = _shared_masks(kept)
    a = rows.withColumnRenamed("line3d_id", "src")
    b = rows.withColumnRenamed("line3d_id", "dst")
    pairs = a.join(b, ["cam_id", "mask_id"]).where("src < dst").select("src", "dst")
    return spread(pairs, total, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= required_views)


def _views_of_lines(line_mask: DataFrame) -> DataFrame:
    return line_mask.groupBy("line3d_id").agg(F.sort_array(F.collect_set("cam_id")).alias("views"))


def covisible(edges: DataFrame, line_mask: DataFrame) -> DataFrame:
    """(src, dst, weight, common): the views that see both ends of each edge; an edge meets its ends' lists of views, not each view by a row."""
    views = _views_of_lines(line_mask)
    a, b = (views.select(F.col("line3d_id").alias(end), F.col("views").alias(f"at_{end}")) for end in ("src", "dst"))
    common = F.size(F.array_intersect("at_src", "at_dst")).cast("long")
    # exploded, so that the filter does not work the lists out a second time
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "weight", F.explode(F.array(common)).alias("common")).where("common > 0")


def covisible_pairs(line_mask: DataFrame) -> DataFrame:
    """(src, dst, weight, common): every pair that shares a mask, with the views that see both ends.

    Lines bring their lists of views to their masks, so a pair's common views are counted where the pair is made: what is
    shuffled is a row a line and mask, and a row a pair. Where pairs are more than one task's, lists go in some two bytes
    a view, and pairs in packs, equal ones summed before.
    """
    rows = kept_masks(line_mask)
    whole = all(isinstance(rows.schema[c].dataType, (T.LongType, T.IntegerType)) for c in ("cam_id", "mask_id", "line3d_id"))
    seen = rows.where("cam_id is not null and line3d_id is not null")
    known, key = seen.where("mask_id is not null"), ["cam_id", "mask_id"]
    total = known.count()
    sizes = settled(spread(known, total, *key).groupBy(*key).agg(F.count(F.lit(1)).alias("lines")).where("lines > 1"))
    found = sizes.agg(F.sum(F.expr("lines * (lines - 1) div 2")).alias("pairs"), F.max("lines").alias("most")).first()
    shared = lambda test: spread(known, total, *key).join(sizes.where(test).select(*key), key, "left_semi")
    pairs = found.pairs or 0
    if not whole or pairs <= joins.TASK_ROWS:
        joined = _joined_pairs(shared("true"), seen)
        return spread(joined, pairs, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.max("common").cast("long").alias("common"))
    parts, kind = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.schema["line3d_id"].dataType
    buckets, few = max(parts, -(-pairs // joins.TASK_ROWS)), f"lines <= {packed_pairs.MASK_LINES}"
    views = _views_of_lines(spread(seen, total, "line3d_id")).mapInArrow(packed_pairs.packed_lists, f"line3d_id {kind.simpleString()}, views binary")
    own = shared(few).join(views, "line3d_id").select(*key, "line3d_id", "views")
    own = own.repartition(max(parts, -(-total // joins.TASK_ROWS)), *key).sortWithinPartitions(*key)
    packs = own.mapInArrow(packed_pairs.pairs_of_masks(buckets), "bucket int, pack binary")
    if found.most > packed_pairs.MASK_LINES:
        packs = packs.unionByName(_joined_pairs(shared(f"not {few}"), seen).mapInArrow(packed_pairs.packed_pairs(buckets), "bucket int, pack binary"))
    return packed_pairs.summed(packs, buckets).select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "weight", "common")


def _joined_pairs(shared: DataFrame, seen: DataFrame) -> DataFrame:
    """(src, dst, common) of all pairs that share a mask, a row for each mask; lines are seen in the views of ``seen``."""
    own = shared.join(_views_of_lines(seen), "line3d_id")
    a, b = (own.select("cam_id", "mask_id", F.col("line3d_id").alias(end), F.col("views").alias(f"at_{end}")) for end in ("src", "dst"))
    return a.join(b, ["cam_id", "mask_id"]).where("src < dst").select("src", "dst", F.size(F.array_intersect("at_src", "at_dst")).alias("common"))


def normalised(edges: DataFrame, line_mask: DataFrame) -> DataFrame:
    """Edges with the share of common views that agree."""
    return _shares(covisible(edges, line_mask))


def normalised_pairs(line_mask: DataFrame) -> DataFrame:
    """Every pair that shares a mask, with the share of common views that agree."""
    return _shares(covisible_pairs(line_mask))


def _shares(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", (F.col("weight") / F.col("common")).alias("weight"))


def with_singletons(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, member_id): every node, alone where it has no label."""
    own = nodes.select(F.col("id").alias("member_id")).distinct()
    named = labels.select(F.col("node").alias("member_id"), F.col("component").alias("label"))
    return own.join(named, "member_id", "left").select(F.coalesce("label", "member_id").alias("cluster_id"), "member_id")


def strict_clusters(line_mask: DataFrame, required_views: int = 3) -> DataFrame:
    """Connected components of the co-occurrence graph."""
    return strict_graph(line_mask, required_views)[0]


def strict_graph(line_mask: DataFrame, required_views: int = 3) -> tuple[DataFrame, DataFrame]:
    """The clusters of ``strict_clusters`` and the edges they come from, with the pairs of lines made once for both."""
    rows = kept_masks(line_mask)
    edges = settled(kept_cooccurrence(rows, required_views))
    return with_singletons(rows.select(F.col("line3d_id").alias("id")), connected_components(edges)), edges


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def larger_clusters(clusters: DataFrame, least: int = 2) -> DataFrame:
    return clusters.join(cluster_sizes(clusters).where(F.col("size") >= least).select("cluster_id"), "cluster_id", "left_semi")


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """One row: clusters, clusters of two members or more, members."""
    return cluster_sizes(clusters).agg(F.count(F.lit(1)).alias("clusters"), F.sum((F.col("size") > 1).cast("long")).alias("larger"), F.sum("size").alias("members"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _half_round(labels: DataFrame, links: DataFrame, parity: int) -> DataFrame:
    """Nodes of one parity take the label with most weight around them, ties to the smallest."""
    near = links.where(F.pmod("src", F.lit(2)) == parity).join(labels.select(F.col("id").alias("dst"), "label"), "dst")
    votes = near.groupBy("src", "label").agg(F.sum("weight").alias("w"))
    best = votes.groupBy(F.col("src").alias("id")).agg(F.max(F.struct("w", (-F.col("label")).alias("low"))).alias("top"))
    return labels.join(best, "id", "left").select("id", "before", F.coalesce(-F.col("top.low"), "label").alias("label"))


def _changed(labels: DataFrame) -> bool:
    return labels.where("label <> before").limit(1).count() > 0


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(cluster_id, member_id) by label propagation in two half-rounds, even ids first; stops when no label changes."""
    links = settled(both_ways(edges))
    labels = nodes.select("id").distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        labels = labels.withColumn("before", F.col("label"))
        labels = settled(_half_round(_half_round(labels, links, 0), links, 1))
        if not _changed(labels):
            break
    return labels.select(F.col("label").alias("cluster_id"), F.col("id").alias("member_id"))


def modularity(clusters: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of a partition."""
    label = clusters.select(F.col("member_id").alias("id"), "cluster_id")
    ends = edges.join(label.select(F.col("id").alias("src"), F.col("cluster_id").alias("ca")), "src").join(label.select(F.col("id").alias("dst"), F.col("cluster_id").alias("cb")), "dst")
    inner = ends.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("inner"))
    degree = ends.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("degree"))
    per = degree.join(inner, "c", "left").select("degree", F.coalesce("inner", F.lit(0)).alias("inner"))
    total = F.sum("degree") / 2
    return per.agg((F.sum("inner") / total - F.lit(resolution) * F.sum(F.col("degree") * F.col("degree")) / (4 * total * total)).alias("modularity"))


#: Neighbours in one row of the walks' table; a hub has several rows.
RANGE_ROWS = 64


def random_walks(nodes: DataFrame, edges: DataFrame, walks: int = 200, length: int = 30, seed: int = 1) -> DataFrame:
    """(walk_id, start, path): weighted first-order walks from every node; a node without edges walks alone.

    A node's neighbours own ranges of [0, 1), cut into one slot for each ``RANGE_ROWS`` neighbours. Every step joins the
    walkers with the slot that their draw falls in: one join a step, no walk in the driver, and no hub sends its
    whole list to each walker.
    """
    links = both_ways(edges)
    line = Window.partitionBy("src").orderBy("dst")
    everything = Window.partitionBy("src")
    upto = F.sum("weight").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("weight").over(everything)
    slots = settled(links.groupBy(F.col("src").alias("id")).agg(F.ceil(F.count(F.lit(1)) / RANGE_ROWS).cast("int").alias("slots")))
    ranges = links.withColumn("high", upto).withColumn("low", F.coalesce(F.lag("high").over(line), F.lit(0.0)))
    ranges = ranges.join(slots.withColumnRenamed("id", "src"), "src").join(slots.select(F.col("id").alias("dst"), F.col("slots").alias("then")), "dst")
    slot = lambda v: F.least(F.floor(v * F.col("slots")), F.col("slots") - 1).cast("int")
    ranges = ranges.withColumn("slot", F.explode(F.sequence(slot(F.col("low")), slot(F.col("high")))))
    ranges = settled(ranges.groupBy(F.col("src").alias("at"), "slot").agg(F.sort_array(F.collect_list(F.struct("low", "high", "dst", "then"))).alias("next")))
    out = nodes.select("id").distinct().join(slots, "id", "left").withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))))
    out = out.select(F.col("id").alias("start"), F.xxhash64("id", "walk", F.lit(seed)).alias("walk_id"), F.col("id").alias("at"), F.coalesce("slots", F.lit(1)).alias("slots"), F.array("id").alias("path"))
    for step in range(1, length):
        draw = F.pmod(F.xxhash64("walk_id", F.lit(step)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        out = out.withColumn("draw", draw).withColumn("slot", slot(F.col("draw"))).join(ranges, ["at", "slot"], "left")
        chosen = F.coalesce(F.get(F.expr("filter(next, x -> draw >= x.low and draw < x.high)"), F.lit(0)), F.element_at("next", -1))
        out = out.withColumn("to", chosen).select(
            "start", "walk_id", F.coalesce("to.dst", "at").alias("at"), F.coalesce("to.then", "slots").alias("slots"), F.when(F.col("to").isNull(), F.col("path")).otherwise(F.concat("path", F.array("to.dst"))).alias("path")
        )
        if step % 10 == 0:
            out = settled(out)
    return out.select("walk_id", "start", "path")
