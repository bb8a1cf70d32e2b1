"""The condensed tree of a spanning forest: edges split into light and heavy halves, solved apart, and tied together by pointers."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled, stored
from .components import connected_components
from .joins import dealt_join

#: Edges of the forest in one part, about, and so the most that is merged one after another.
BATCH_EDGES = 250_000
#: Clusters whose best choice one task works out instead of rounds.
TASK_CLUSTERS = 200_000

#: A subtree without a cluster. A cluster is named by the rank of the edge that makes it; -2 - r stands for the cluster on top of subtree r.
NONE = -1
_SOLVED = "kind string, id long, ref long, weight long, amount double"


def _kept(df: DataFrame) -> DataFrame:
    """The rows of a round as a written table: a checkpoint hands on what the optimiser knows of its columns, which doubles with every round."""
    return stored(df, "tree")


def _solve(rows, size: int) -> list[tuple]:
    """Merges along the edges of some parts, in order of rank, knowing of each subtree below only its name and weight.

    Rows out: ``top`` (rank of a part's last edge, its cluster), ``own`` (subtree without cluster, the cluster that takes its
    points), ``up`` (such a subtree, the part that it ends in where none does), ``lost`` (cluster, 1 / distance
    summed over points that leave it) and ``closed`` (cluster, the one above, weight and 1 / distance of its end).
    """
    parent: dict[int, int] = {}
    state: dict[int, tuple[int, int]] = {}  # root -> weight, cluster
    waiting: dict[int, list[int]] = {}  # root -> subtrees whose points no cluster has taken
    last: dict[int, int] = {}
    lost: dict[int, float] = defaultdict(float)
    out = []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for side in "ab":
        for x, weight in zip(rows[side].tolist(), rows[f"weight_{side}"].tolist()):
            if x not in parent:
                cluster = -2 - x if x >= 0 and weight >= size else NONE
                parent[x], state[x], waiting[x] = x, (weight, cluster), [x] if cluster == NONE else []
    for rank, distance, a, b in zip(rows["rank"].tolist(), rows["distance"].tolist(), rows["a"].tolist(), rows["b"].tolist()):
        level = 1 / max(distance, 1e-12)
        x, y = find(a), find(b)
        if state[x][1] == NONE:
            x, y = y, x
        (wx, cx), (wy, cy) = state.pop(x), state.pop(y)
        weight, small, cluster = wx + wy, waiting.pop(x) + waiting.pop(y), cx
        if cy != NONE:  # two clusters end and a new one holds them
            out += [("closed", c, rank, w, level) for c, w in ((cx, wx), (cy, wy))]
            cluster = rank
            lost[rank] += level * weight
        elif cx != NONE:
            lost[cx] += level * wy
        elif weight >= size:
            cluster = rank
            lost[rank] += level * weight
        if cluster != NONE:
            out += [("own", s, cluster, 0, 0.0) for s in small]
            small = []
        parent[y], state[x], waiting[x], last[x] = x, (weight, cluster), small, rank
    for x, (weight, cluster) in state.items():
        if cluster != NONE:
            out.append(("top", last[x], cluster, weight, 0.0))
        out += [("up", s, last[x], 0, 0.0) for s in waiting[x]]
    return out + [("lost", c, 0, 0, amount) for c, amount in lost.items()]


def _contracted(edges: DataFrame, bit: int, total: int) -> DataFrame:
    """Heavy halves over what their light halves connect; halves differ in a bit of the batch.

    A connected piece of a light half is one subtree of the dendrogram, named by its heaviest edge.
    """
    heavy = F.shiftright("batch", bit).bitwiseAND(F.lit(1)) == 1
    light = edges.where(~heavy)
    ends = F.explode(F.array(*(F.struct(F.col(s).alias("node"), F.col(f"weight_{s}").alias("weight"), "rank") for s in "ab"))).alias("e")
    seen = light.select(ends).select("e.*").groupBy("node").agg(F.first("weight").alias("weight"), F.max("rank").alias("rank"))
    pieces = settled(connected_components(light.select(F.col("a").alias("src"), F.col("b").alias("dst"))).join(seen, "node"))
    named = pieces.groupBy("component").agg(F.max("rank").alias("name"), F.sum("weight").alias("whole"))
    found = settled(dealt_join(pieces.select("node", "component"), named, ["component"], total + 1).drop("component"))
    moved = edges.withColumn("heavy", heavy)  # light rows stay and meet nothing; a union would double the partitions with every level
    for s in "ab":
        own = found.select(F.col("node").alias(s), F.lit(True).alias("heavy"), "name", "whole")
        moved = dealt_join(moved, own, [s, "heavy"], total, how="left").withColumns({s: F.coalesce("name", s), f"weight_{s}": F.coalesce("whole", f"weight_{s}")}).drop("name", "whole")
    return moved.drop("heavy")


def split_forest(forest: DataFrame, batch_edges: int) -> tuple[DataFrame, DataFrame, int, int]:
    """((rank, batch, distance, a, weight_a, b, weight_b), (id, name of a point), edges, batches): no connected part of a batch needs another one's result.

    All halves of a level are split at once, so there are as many levels as the number of batches has bits. Points have negative names.
    """
    edges = settled(forest.select("distance", "src", "dst"))
    total = edges.count()
    batches = max(1, -(-total // batch_edges))
    ordered = edges.repartitionByRange(batches, "distance", "src", "dst").sortWithinPartitions("distance", "src", "dst").withColumn("rank", F.monotonically_increasing_id())
    ordered = settled(ordered.withColumn("batch", F.shiftright("rank", 33).cast("int")))
    ends = F.explode(F.array(*(F.struct(F.col(end).alias("id"), (-1 - 2 * F.col("rank") - side).alias("name")) for side, end in enumerate(("src", "dst"))))).alias("e")
    names = settled(ordered.select(ends).groupBy("e.id").agg(F.max("e.name").alias("name")))
    for end, s in (("src", "a"), ("dst", "b")):
        own = names.select(F.col("id").alias(end), F.col("name").alias(s))
        ordered = dealt_join(ordered, own, [end], total).drop(end).withColumn(f"weight_{s}", F.lit(1).cast("long"))
    ordered = settled(ordered)
    for bit in reversed(range((batches - 1).bit_length())):
        ordered = settled(_contracted(ordered, bit, total))
    return ordered, names, total, batches


def _solved(edges: DataFrame, total: int, batches: int, size: int) -> DataFrame:
    """What ``_solve`` says of every connected part; parts are dealt to twice as many tasks as there are batches."""
    import pandas as pd

    if batches > 1:
        parts = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"node": "a"})
        edges = dealt_join(edges, parts, ["a"], total).withColumn("task", F.pmod(F.xxhash64("component"), F.lit(2 * batches)))
    else:
        edges = edges.withColumn("task", F.lit(0))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_solve(rows.sort_values("rank"), size), columns=[f.split()[0] for f in _SOLVED.split(", ")])

    return settled(edges.groupBy("task").applyInPandas(run, _SOLVED))


def _best_in_task(tree: DataFrame) -> DataFrame:
    """(cluster, below): one task; a cluster's children have lower names than it."""

    def run(batches):
        below: dict[int, float] = defaultdict(float)
        for batch in batches:
            own = []
            for cluster, above, stability in zip(batch["cluster"].tolist(), batch["above"].tolist(), batch["stability"].tolist()):
                own.append(below.pop(cluster, 0.0))
                if above >= 0:
                    below[above] += max(stability, own[-1])
            yield batch[["cluster"]].assign(below=own)

    rows = tree.select("cluster", F.coalesce("above", F.lit(-1)).alias("above"), "stability")
    return rows.coalesce(1).sortWithinPartitions("cluster").mapInPandas(run, "cluster long, below double")


def _best_in_rounds(tree: DataFrame, total: int) -> DataFrame:
    """(cluster, below): a cluster is known when both children are; one with a known child is max(a, b + x) of the other, and such steps are
    composed, so that a chain halves with every round."""
    inner = tree.where("above is not null").select(F.col("above").alias("cluster"), F.lit(True).alias("inner")).distinct()
    empty = {"a": "double", "b": "double", "next": "long"}
    rows = _kept(tree.join(inner, "cluster", "left").select("cluster", "above", "stability", F.when(F.col("inner").isNull(), F.greatest("stability", F.lit(0.0))).alias("value"), *(F.lit(None).cast(t).alias(c) for c, t in empty.items())))
    while rows.where("value is null").limit(1).count():
        kids = rows.where("above is not null").groupBy(F.col("above").alias("cluster")).agg(F.count("value").alias("known"), F.sum("value").alias("total"), F.min(F.when(F.col("value").isNull(), F.col("cluster"))).alias("other"))
        one = F.col("known") == 1
        learnt = {"value": F.when(F.col("known") == 2, F.greatest("stability", "total")), "a": F.when(one, F.col("stability")), "b": F.when(one, F.col("total")), "next": F.when(one, F.col("other"))}
        rows = _kept(rows.join(kids, "cluster", "left").select("cluster", "above", "stability", *(F.coalesce(c, v).alias(c) for c, v in learnt.items())))
        asks = F.when(F.col("value").isNull(), F.col("next"))
        ahead = rows.select(F.col("cluster").alias("ask"), F.col("value").alias("value_n"), F.col("a").alias("a_n"), F.col("b").alias("b_n"), F.col("next").alias("next_n"))
        step = F.col("value_n").isNull() & F.col("next_n").isNotNull()
        found = {"value": F.greatest("a", F.col("b") + F.col("value_n")), "a": F.when(step, F.greatest("a", F.col("b") + F.col("a_n"))).otherwise(F.col("a")), "b": F.when(step, F.col("b") + F.col("b_n")).otherwise(F.col("b")), "next": F.when(step, F.col("next_n")).otherwise(F.col("next"))}
        found["value"] = F.when(F.col("value_n").isNotNull(), found["value"])
        found["value"] = F.coalesce("value", found["value"])
        asked = rows.withColumn("ask", F.coalesce(asks, -1 - F.col("cluster")))  # rows that ask nothing are spread, too
        rows = _kept(dealt_join(asked, ahead, ["ask"], total, how="left").select("cluster", "above", "stability", *(v.alias(c) for c, v in found.items())))
    below = rows.where("above is not null").groupBy(F.col("above").alias("cluster")).agg(F.sum("value").alias("below"))
    return tree.select("cluster").join(below, "cluster", "left").fillna({"below": 0.0})


def condensed_tree(forest: DataFrame, nodes: DataFrame, size: int, far: float | None = None, batch_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, owner), (cluster, above, chosen)) of one tree over all nodes; parts of the forest meet at distance ``far``, or infinitely far off.

    Batches of about ``batch_edges`` edges are solved at the same time. What one says of a cluster that another made, it
    says by that one's name, and pointer doubling finds the cluster. The cluster that all others end in, the
    root, is never chosen. Sums are taken in the order that Spark finds, so stabilities that are equal but for rounding may fall either way.
    """
    edges, names, total, batches = split_forest(forest, batch_edges or BATCH_EDGES)
    solved = _solved(edges, total, batches, size)
    tops = solved.where("kind = 'top'").select(F.col("id").alias("top"), "ref", "weight")
    while batches > 1 and tops.where("ref < -1").limit(1).count():
        lower = tops.select((-2 - F.col("top")).alias("ref"), F.col("ref").alias("next"))
        tops = _kept(tops.join(lower, "ref", "left").select("top", F.coalesce("next", "ref").alias("ref"), "weight"))
    meant = _kept(tops.select((-2 - F.col("top")).alias("symbol"), F.col("ref").alias("cluster")))

    def clusters(rows: DataFrame, column: str) -> DataFrame:
        """The rows with the cluster that a column means."""
        if batches == 1:
            return rows.withColumn("cluster", F.col(column))
        own = dealt_join(rows.withColumn("symbol", F.col(column)), meant.withColumnRenamed("cluster", "lower"), ["symbol"], total, how="left")
        return own.withColumn("cluster", F.coalesce("lower", column)).drop("symbol", "lower")

    held = clusters(solved.where("kind = 'own'").select("id", "ref"), "ref").select("id", F.col("cluster").alias("owner"), F.lit(None).cast("long").alias("up"))
    held = _kept(held.unionByName(solved.where("kind = 'up'").select("id", F.lit(None).cast("long").alias("owner"), F.col("ref").alias("up"))))
    while batches > 1 and held.where("up is not null").limit(1).count():
        above = held.where("id >= 0").select(F.col("id").alias("ask"), F.col("owner").alias("owner_up"), F.col("up").alias("next"))
        risen = held.withColumn("ask", F.coalesce("up", -1 - F.abs("id"))).join(above, "ask", "left")
        held = _kept(risen.select("id", F.coalesce("owner", "owner_up").alias("owner"), F.col("next").alias("up")))
    named = nodes.select("id").distinct().join(names, "id", "left")
    owners = named.join(held.select(F.col("id").alias("name"), "owner"), "name", "left").select("id", "owner")

    lost = clusters(solved.where("kind = 'lost'").select("id", "amount"), "id").groupBy("cluster").agg(F.sum("amount").alias("lost"))
    closed = clusters(solved.where("kind = 'closed'").select("id", F.col("ref").alias("above"), "weight", F.col("amount").alias("level")), "id").drop("id")
    whole = tops.groupBy(F.col("ref").alias("cluster")).agg(F.max("weight").alias("whole"))
    tree = lost.join(closed, "cluster", "left").join(whole, "cluster", "left")
    level = F.coalesce("level", F.lit(1 / far if far else 0.0))
    tree = _kept(tree.select("cluster", "above", (F.col("lost") - level * F.coalesce("weight", "whole")).alias("stability")))
    several = tree.where("above is null").limit(2).count() > 1  # a single root is the root of all
    count = tree.count()
    below = _best_in_task(tree) if count <= TASK_CLUSTERS else _best_in_rounds(tree, count)
    chosen = (F.col("stability") >= F.col("below")) & (F.col("above").isNotNull() | F.lit(several))
    return owners, _kept(tree.join(below, "cluster").select("cluster", "above", chosen.alias("chosen")))


def tree_labels(owners: DataFrame, clusters: DataFrame) -> DataFrame:
    """(member_id, label) of a condensed tree; every round doubles the distance upwards that a cluster knows."""
    known = clusters.select("cluster", F.col("above"), F.when(F.col("chosen"), F.col("cluster")).alias("label"))
    while known.where("above is not null").limit(1).count():
        up = known.select(F.col("cluster").alias("above"), F.col("above").alias("next"), F.col("label").alias("higher"))
        known = _kept(known.join(up, "above", "left").select("cluster", F.col("next").alias("above"), F.coalesce("higher", "label").alias("label")))
    marked = _kept(owners.join(known.select(F.col("cluster").alias("owner"), "label"), "owner", "left").select(F.col("id").alias("member_id"), "label"))
    names = marked.where("label is not null").groupBy("label").agg(F.min("member_id").alias("name"))
    return marked.join(names, "label", "left").select("member_id", F.coalesce("name", F.lit(-1)).cast("long").alias("label"))
