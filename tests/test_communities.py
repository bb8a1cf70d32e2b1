import random

import pytest
from pyspark.sql import functions as F
from strandloom.operators import communities as C
from strandloom.operators import components
from strandloom.operators.graph import modularity


def plain_quality(label, edges, resolution=1.0):
    total = sum(w for *_, w in edges)
    size = {}
    for a, b, w in edges:
        for x in (a, b):
            size[label[x]] = size.get(label[x], 0) + w
    return sum(w for a, b, w in edges if label[a] == label[b]) / total - resolution * sum(s * s for s in size.values()) / (4 * total * total)


def plain_best(edges, resolution=1.0):
    """Moves and merges that raise modularity, by its definition, until there is none."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    label, best = {n: n for n in nodes}, None
    near = {n: set() for n in nodes}
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    best, better = plain_quality(label, edges, resolution), True
    while better:
        better = False
        for n in nodes:
            for c in sorted({label[m] for m in near[n]} - {label[n]}):
                was, label[n] = label[n], c
                if (q := plain_quality(label, edges, resolution)) > best + 1e-9:
                    best, better = q, True
                else:
                    label[n] = was
        for c, d in sorted({(label[a], label[b]) for a, b, _ in edges if label[a] != label[b]}):
            other = {n: d if label[n] == c else label[n] for n in nodes}
            if (q := plain_quality(other, edges, resolution)) > best + 1e-9:
                label, best, better = other, q, True
    return best


def graph(seed):
    """Blocks, chains, stars and noise, in several components."""
    rng = random.Random(seed)
    edges, at = {}, 0
    for _ in range(rng.choice((2, 4))):
        size = rng.choice((12, 20))
        for i in range(size):
            for j in range(i):
                if rng.random() < (0.6 if i // 5 == j // 5 else 0.04):
                    edges[at + j, at + i] = rng.choice((1, 2, 3.5))
        at += size
    for i in range(8):
        edges[at + i, at + i + 1] = 1
        edges[at + 20, at + 21 + i] = 2
    return [(a, b, float(w)) for (a, b), w in edges.items()]


def hangs_together(label, edges):
    for c in set(label.values()):
        own = {n for n in label if label[n] == c}
        seen, todo = set(), [min(own)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [m for a, b, _ in edges for m in ((b,) if a == n else (a,) if b == n else ()) if m in own]
        if seen != own or min(own) != c:
            return False
    return True


def found(spark, edges, **options):
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = df.select(F.explode(F.array("src", "dst")).alias("id"))
    rows = C.leiden(nodes, df, **options).collect()
    assert len(rows) == nodes.distinct().count()
    return {r.member_id: r.cluster_id for r in rows}


@pytest.mark.parametrize("seed", range(10))
def test_modularity_is_that_of_a_plain_search(seed):
    edges = graph(seed)
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    code = {n: i for i, n in enumerate(nodes)}
    for resolution in (1.0, 0.4):
        own = C.communities(len(nodes), [(code[a], code[b], w) for a, b, w in edges], sum(w for *_, w in edges), resolution)
        label = {n: nodes[own[code[n]]] for n in nodes}
        assert hangs_together(label, edges)
        assert plain_quality(label, edges, resolution) >= plain_best(edges, resolution) - 0.01 * abs(plain_best(edges, resolution))


def test_joins_find_what_a_task_finds(spark):
    edges = graph(3)
    task, joins = found(spark, edges), found(spark, edges, task_edges=10)
    assert hangs_together(task, edges) and hangs_together(joins, edges)
    assert plain_quality(task, edges) >= 0.99 * plain_best(edges)
    assert plain_quality(joins, edges) >= 0.99 * plain_best(edges)


def test_communities_that_moves_alone_would_tear_apart_hang_together():
    """A bridge node leaves its community, whose two halves must not stay one."""
    ends = [(0, 1, 1.0), (0, 4, 1.0), (1, 2, 2.0), (1, 3, 2.0), (2, 3, 2.0), (4, 5, 2.0), (4, 6, 2.0), (5, 6, 2.0), (0, 7, 5.0), (7, 8, 1.0), (7, 9, 1.0), (8, 9, 3.0)]
    label = C.communities(10, ends, sum(w for *_, w in ends), 1.0, start=[0] * 10)
    assert hangs_together(dict(enumerate(label)), ends)


def test_defined_cases(spark):
    edges = [(1, 1, 2.0), (2, 3, 1.0), (3, 2, 1.0), (None, 4, 1.0), (5, 6, 0.0), (5, 6, None), (7, 7, -1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 7, 7)], "id long")
    rows = sorted((r.member_id, r.cluster_id) for r in C.leiden(nodes, df).collect())
    assert rows == [(1, 1), (2, 2), (3, 2), (4, 4), (5, 5), (6, 6), (7, 7)]
    assert sorted(tuple(r) for r in C.leiden(nodes, df.limit(0)).collect()) == [(i, i) for i in range(1, 8)]
    q = modularity(C.leiden(nodes, df), df.where("weight > 0 and src is not null")).first().modularity
    assert q == pytest.approx(0.5)


def test_components_in_a_task_are_those_of_rounds(spark, monkeypatch):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 480)] + [(7, 7), (None, 3), (999, 999)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    once = sorted(tuple(r) for r in components.connected_components(df).collect())
    monkeypatch.setattr(components, "TASK_PAIRS", 0)
    assert once == sorted(tuple(r) for r in components.connected_components(df).collect())
