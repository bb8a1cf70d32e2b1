"""Modularity communities (Leiden): local moving, refinement, aggregation.

No community spans two connected components, so components are solved by themselves under the whole graph's weight.
Components of ``TASK_EDGES`` edges at most go one after another through the tasks that Spark deals them to; larger ones take
levels of joins, by the same rule, until aggregation has made them small enough.

The rule: nodes move to the neighbouring community of largest modularity gain (ties to the smallest label), and after a move only its neighbours
in other communities are asked again. When nobody moves, every community is refined, that is taken apart into parts
that hang together, the parts become nodes, and the communities are where these start.

In joins a round takes many moves at once. A hashed half of the nodes moves together as long as that raises
modularity; then only moves that share no community with a better one are taken, whose gains add up exactly, so modularity rises to
the end. Nothing is cut off: a run that does not settle within ``MOST_ROUNDS`` raises.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled, stored
from .components import connected_components
from .joins import dealt_join

#: Edges of a component that one task takes; no other bound decides what a task holds.
TASK_EDGES = 200_000
MOST_ROUNDS = 2_000
_LEAST_GAIN = 1e-10


class Level:
    """A graph of one level in a task: neighbours without loops, degrees with them."""

    def __init__(self, n: int, ends: list[tuple[int, int, float]]):
        self.near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
        self.degree = [0.0] * n
        self.loops = [0.0] * n
        for a, b, w in ends:
            self.degree[a] += w
            self.degree[b] += w
            if a == b:
                self.loops[a] += w
            else:
                self.near[a][b] += w
                self.near[b][a] += w

    def moved(self, label: list[int], share: float) -> bool:
        """Move nodes (labels change in place) until no asked node gains; ``share`` is resolution / (2 * total weight)."""
        size: dict[int, float] = defaultdict(float)
        held: dict[int, int] = defaultdict(int)
        for i, c in enumerate(label):
            size[c] += self.degree[i]
            held[c] += 1
        free = [c for c in range(len(label)) if not held[c]]
        queue, waits, any_move = deque(range(len(label))), [True] * len(label), False
        while queue:
            i = queue.popleft()
            waits[i] = False
            own, d = label[i], self.degree[i]
            weight: dict[int, float] = defaultdict(float)
            for j, w in self.near[i].items():
                weight[label[j]] += w
            size[own] -= d
            best, most = own, weight.get(own, 0.0) - share * d * size[own]
            for c in sorted(weight):
                if (gain := weight[c] - share * d * size[c]) > most + _LEAST_GAIN:
                    best, most = c, gain
            if most < -_LEAST_GAIN and held[own] > 1:  # better alone
                best = free.pop()
            size[best] += d
            if best != own:
                label[i], any_move = best, True
                held[own] -= 1
                held[best] += 1
                if not held[own]:
                    size[own] = 0.0
                    free.append(own)
                for j in self.near[i]:
                    if label[j] != best and not waits[j]:
                        waits[j] = True
                        queue.append(j)
        return any_move

    def refined(self, label: list[int], share: float) -> list[int]:
        """Parts of the communities: a node that is still alone joins the part of its community that gains most, if both are well connected to the community."""
        n = len(label)
        whole: dict[int, float] = defaultdict(float)
        for i, c in enumerate(label):
            whole[c] += self.degree[i]
        part, size, alone = list(range(n)), list(self.degree), [True] * n
        cut = [sum(w for j, w in self.near[i].items() if label[j] == label[i]) for i in range(n)]
        well = lambda p, c: cut[p] >= share * size[p] * (whole[c] - size[p]) - _LEAST_GAIN
        for i in range(n):
            c = label[i]
            if not alone[i] or not well(i, c):
                continue
            weight: dict[int, float] = defaultdict(float)
            for j, w in self.near[i].items():
                if label[j] == c:
                    weight[part[j]] += w
            best, most = i, _LEAST_GAIN
            for p in sorted(weight):
                if well(p, c) and (gain := weight[p] - share * self.degree[i] * size[p]) > most:
                    best, most = p, gain
            if best != i:
                cut[best] += cut[i] - 2 * weight[best]
                size[best] += size[i]
                part[i], alone[i], alone[best] = best, False, False
        return part

    def joined(self, part: list[int]) -> tuple[Level, list[int]]:
        """The level whose nodes are the parts, and the node that each node is in."""
        code = {p: k for k, p in enumerate(sorted(set(part)))}
        at = [code[p] for p in part]
        sums: dict[tuple[int, int], float] = defaultdict(float)
        for i, row in enumerate(self.near):
            sums[at[i], at[i]] += self.loops[i]
            for j, w in row.items():
                if i < j:
                    sums[min(at[i], at[j]), max(at[i], at[j])] += w
        return Level(len(code), [(a, b, w) for (a, b), w in sums.items() if w]), at

    def quality(self, label: list[int], share: float) -> float:
        size, inner = defaultdict(float), 0.0
        for i, c in enumerate(label):
            size[c] += self.degree[i]
            inner += 2 * self.loops[i] + sum(w for j, w in self.near[i].items() if label[j] == c)
        return inner - share * sum(s * s for s in size.values())


def _split(graph: Level, label: list[int]) -> list[int]:
    """Communities taken apart into connected ones, each named by its first node."""
    out = [-1] * len(label)
    for i in range(len(label)):
        if out[i] < 0:
            out[i], todo = i, [i]
            while todo:
                for j in graph.near[todo.pop()]:
                    if out[j] < 0 and label[j] == label[i]:
                        out[j] = i
                        todo.append(j)
    return out


def communities(n: int, ends: list[tuple[int, int, float]], total: float, resolution: float, start: list[int] | None = None) -> list[int]:
    """A community for each of ``n`` nodes, named by its first; ``total`` is the weight of the graph that these edges are a part of."""
    share = resolution / (2 * total)
    base = Level(n, ends)
    label = list(start) if start else list(range(n))
    quality = base.quality(label, share)
    for _ in range(MOST_ROUNDS):
        graph, where, own = base, list(range(n)), list(label)
        while True:
            graph.moved(own, share)
            if len(set(own)) == len(own):
                break
            part = graph.refined(own, share)
            if len(set(part)) == len(part):
                part = _split(graph, own)
            graph, at = graph.joined(part)
            above = [0] * len(graph.degree)
            for i, k in enumerate(at):
                above[k] = own[i]
            code = {c: k for k, c in enumerate(sorted(set(above)))}
            own, where = [code[c] for c in above], [at[k] for k in where]
        found = _split(base, [own[k] for k in where])
        now = base.quality(found, share)
        if now <= quality + _LEAST_GAIN * total:
            return _split(base, label) if quality > now else found
        label, quality = found, now
    raise RuntimeError(f"communities did not settle within {MOST_ROUNDS} runs")


def _component_labels(total: float, resolution: float):
    """Rows (component, src, dst, weight) come by component: (id, label) of its nodes, a community named by its smallest node."""

    def solved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        src, dst, weight = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("src", "dst", "weight"))
        ids, code = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = code[: len(src)], code[len(src) :]
        order = np.lexsort((b, a))
        label = communities(len(ids), list(zip(a[order].tolist(), b[order].tolist(), weight[order].tolist())), total, resolution)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "label"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = batch.column("component").to_numpy()
            edges = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)] if len(own) else []
            for lo, hi in zip(edges, edges[1:]):
                if held and held[-1].column("component")[0].as_py() != own[lo]:
                    yield solved(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield solved(held)

    return run


def _links(edges: DataFrame) -> DataFrame:
    own = edges.where("src <> dst")
    return own.select("src", "dst", "weight").unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def _degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("degree"))


def _quality(labels: DataFrame, links: DataFrame, share: float) -> float:
    """Twice the weight within communities less what chance expects; loops, which no move changes, are left out."""
    a, b = (labels.select(F.col("id").alias(e), F.col("label").alias(f"{e}_label")) for e in ("src", "dst"))
    inner = links.join(a, "src").join(b, "dst").where("src_label = dst_label").agg(F.sum("weight")).first()[0] or 0.0
    sizes = labels.groupBy("label").agg(F.sum("degree").alias("size")).agg(F.sum(F.col("size") * F.col("size"))).first()[0] or 0.0
    return inner - share * sizes


def _offers(labels: DataFrame, links: DataFrame, share: float, count: int) -> DataFrame:
    """(id, own, to, gain) of asked nodes that would gain by moving."""
    size = labels.groupBy("label").agg(F.sum("degree").alias("size"))
    asked = labels.where("asked").select(F.col("id").alias("src"))
    near = dealt_join(links.join(asked, "src", "left_semi"), labels.select(F.col("id").alias("dst"), "label"), ["dst"], count).select(F.col("src").alias("id"), "label", "weight")
    stay = labels.where("asked").select("id", "label", F.lit(0.0).alias("weight"))
    sums = near.unionByName(stay).groupBy("id", "label").agg(F.sum("weight").alias("w"))
    sums = sums.join(labels.select("id", F.col("label").alias("own"), "degree"), "id").join(size, "label")
    stays = F.col("label") == F.col("own")
    gain = F.col("w") - share * F.col("degree") * (F.col("size") - F.when(stays, F.col("degree")).otherwise(0.0))
    best = sums.select("id", "own", "label", gain.alias("gain"), stays.alias("stays"))
    own = best.groupBy("id", "own").agg(F.max(F.when(F.col("stays"), F.col("gain"))).alias("stay"), F.max(F.when(~F.col("stays"), F.struct("gain", (-F.col("label")).alias("low")))).alias("top"))
    return own.where(F.col("top.gain") > F.col("stay") + _LEAST_GAIN).select("id", "own", (-F.col("top.low")).alias("to"), (F.col("top.gain") - F.col("stay")).alias("gain"))


def _moved(labels: DataFrame, links: DataFrame, share: float) -> DataFrame:
    """(id, label, degree) after moves of (id, label, degree), by the rule of the module."""
    count = links.count()
    labels = settled(labels.select("id", "label", "degree", F.lit(True).alias("asked")))
    quality, halves = _quality(labels, links, share), True
    for turn in range(MOST_ROUNDS):
        offers = settled(_offers(labels, links, share, count))
        if not offers.limit(1).count():
            return labels.drop("asked")
        taken = None
        if halves:
            taken = settled(offers.where(F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2).select("id", F.col("to").alias("new")))
        together = taken is not None and taken.limit(1).count() > 0
        if not together:
            rank = F.struct("gain", (-F.col("id")).alias("low"))
            top = offers.select(F.explode(F.array("own", "to")).alias("c"), rank.alias("r")).groupBy("c").agg(F.max("r").alias("r"))
            first, second = (top.select(F.col("c").alias(e), F.col("r.low").alias(f"{e}_low")) for e in ("own", "to"))
            taken = settled(offers.join(first, "own").join(second, "to").where("own_low = -id and to_low = -id").select("id", F.col("to").alias("new")))
        # neighbours of what moved are asked again, as are those whose own move waits
        around = dealt_join(links.select("src", F.col("dst").alias("id")), taken.select(F.col("id").alias("src"), "new"), ["src"], count).groupBy("id").agg(F.min("new").alias("low"), F.max("new").alias("high"))
        waits = offers.join(taken, "id", "left_anti").select("id", F.lit(True).alias("waits"))
        told = labels.join(taken, "id", "left").join(around, "id", "left").join(waits, "id", "left")
        label = F.coalesce("new", "label")
        again = F.col("waits").isNotNull() | (F.col("low").isNotNull() & ((F.col("low") != label) | (F.col("high") != label)))
        # a table, since a checkpoint hands on what the optimizer infers of its columns, which grows with every round
        now = stored(told.select("id", label.alias("label"), "degree", again.alias("asked")), "moves")
        if halves:
            better = _quality(now, links, share)
            if together and better <= quality:
                halves = False
                continue
            quality = better
        labels = now
    raise RuntimeError(f"moves did not settle within {MOST_ROUNDS} rounds")


def _within(links: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = (labels.select(F.col("id").alias(e), F.col("label").alias(f"{e}_label")) for e in ("src", "dst"))
    return links.join(a, "src").join(b, "dst").where("src_label = dst_label").select("src", "dst", "weight")


def _one_level(edges: DataFrame, labels: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """((id, label) after moves, (id, part) to join) of a graph too large for a task."""
    links = settled(_links(edges))
    moved = settled(_moved(labels, links, share))
    inner = settled(_within(links, moved))
    parts = _moved(moved.select("id", F.col("id").alias("label"), "degree"), inner, share)
    held = connected_components(_within(inner, parts).where("src < dst").select("src", "dst")).withColumnsRenamed({"node": "id", "component": "part"})
    if not held.limit(1).count():  # no part joins another: the communities themselves are joined
        held = connected_components(inner.where("src < dst").select("src", "dst")).withColumnsRenamed({"node": "id", "component": "part"})
    named = settled(moved.join(held, "id", "left").select("id", F.coalesce("part", "id").alias("part")))
    return moved.select("id", "label"), named


def leiden(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, task_edges: int | None = None) -> DataFrame:
    """(cluster_id, member_id): modularity communities of (src, dst, weight), each connected, named by its smallest node.

    Nodes without edges stay alone; edges with a null end or weight, or without a positive weight, are left out;
    edges that repeat add up; an empty graph has one cluster for each node.
    """
    task_edges = TASK_EDGES if task_edges is None else task_edges
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    edges = edges.where("src is not null and dst is not null and weight > 0").groupBy(*ends).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    edges = settled(edges)
    total = edges.agg(F.sum("weight")).first()[0] or 0.0
    own = nodes.select(F.col("id").alias("member_id")).distinct()
    if not total:
        return own.select(F.col("member_id").alias("cluster_id"), "member_id")
    share = resolution / (2 * total)
    member = settled(_degrees(edges).select(F.col("id").alias("member_id"), "id"))
    start, done = None, None
    for _ in range(MOST_ROUNDS):
        parts = connected_components(edges.select("src", "dst")).withColumnRenamed("node", "src")
        placed = settled(edges.join(parts, "src"))
        sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        large = settled(sizes.where(F.col("n") > task_edges).select("component"))
        small = placed.join(large, "component", "left_anti")
        solved = small.repartition("component").sortWithinPartitions("component").mapInArrow(_component_labels(total, resolution), "id long, label long")
        solved = settled(solved)
        done = solved if done is None else done.unionByName(solved)
        if not large.limit(1).count():
            break
        rest = settled(placed.join(large, "component", "left_semi").select("src", "dst", "weight"))
        labels = _degrees(rest)
        labels = labels.withColumn("label", F.col("id")) if start is None else labels.join(start, "id")
        moved, named = _one_level(rest, labels, share)
        fewer = named.where("id <> part").limit(1).count() > 0
        if not fewer:  # nothing joins: the communities are what was found
            done = settled(done.unionByName(moved))
            break
        to = named.select("id", F.col("part").alias("to"))
        start = settled(moved.join(to, "id").groupBy(F.col("to").alias("id")).agg(F.min("label").alias("label")))
        member = settled(member.join(to, "id", "left").select("member_id", F.coalesce("to", "id").alias("id")))
        a, b = (to.withColumnsRenamed({"id": e, "to": f"{e}_to"}) for e in ("src", "dst"))
        joined = rest.join(a, "src").join(b, "dst").select(F.least("src_to", "dst_to").alias("src"), F.greatest("src_to", "dst_to").alias("dst"), "weight")
        edges = settled(joined.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    else:
        raise RuntimeError(f"levels did not settle within {MOST_ROUNDS}")
    named = settled(member.join(done, "id").select("member_id", "label"))
    low = named.groupBy("label").agg(F.min("member_id").alias("cluster_id"))
    named = named.join(low, "label").select("member_id", "cluster_id")
    return own.join(named, "member_id", "left").select(F.coalesce("cluster_id", "member_id").alias("cluster_id"), "member_id")
