import random

import pytest
from pyspark.sql import functions as F
from strandloom.operators import dendrogram as T
from strandloom.operators.components import connected_components

FOREST = "distance double, src long, dst long"


def forest_of(kind, n, seed):
    """Edges of a forest: random trees, a caterpillar of clusters that join one by one, or a star."""
    rng = random.Random(seed)
    if kind == "random":
        return [(rng.uniform(1, 9), rng.randrange(i), i) for i in range(1, n) if i % 97]
    if kind == "star":
        return [(rng.uniform(1, 9), 0, i) for i in range(1, n)]
    out = []
    for i in range(1, n):  # groups of four, group after group further off
        out.append((rng.uniform(0.1, 0.2), i - 1, i) if i % 4 else (1 + i / 100, i - 1, i))
    return out


def plain_tree(edges, nodes, size, far):
    """{point: set of points of its topmost chosen cluster, or None} by explicit recursion over sets."""
    group = {v: {"points": [v], "cluster": None} for v in nodes}
    for d, a, b in sorted(edges):
        x, y = group[a], group[b]
        level, big = 1 / d, [g for g in (x, y) if g["cluster"]]
        merged = {"points": x["points"] + y["points"]}
        if len(big) == 2:
            kids = []
            for g in big:
                c = g["cluster"]
                c["stability"] = c["lost"] - level * len(g["points"])
                c["points"] = g["points"]
                kids.append(c)
            merged["cluster"] = {"lost": level * len(merged["points"]), "kids": kids}
        elif big:
            merged["cluster"] = big[0]["cluster"]
            merged["cluster"]["lost"] += level * (len(merged["points"]) - len(big[0]["points"]))
        else:
            merged["cluster"] = {"lost": level * len(merged["points"]), "kids": []} if len(merged["points"]) >= size else None
        for v in merged["points"]:
            group[v] = merged
    tops = [g for g in {id(g): g for g in group.values()}.values() if g["cluster"]]
    labels = dict.fromkeys(nodes, -1)

    def best(c):
        below, sets = 0.0, []
        for kid in c["kids"]:
            value, own = best(kid)
            below, sets = below + value, sets + own
        return (c["stability"], [c]) if c["stability"] >= below else (below, sets)

    for g in tops:
        c = g["cluster"]
        c["points"], c["stability"] = g["points"], c["lost"] - (1 / far if far else 0) * len(g["points"])
        sets = best(c)[1] if len(tops) > 1 else [s for kid in c["kids"] for s in best(kid)[1]]
        for s in sets:
            labels.update(dict.fromkeys(s["points"], min(s["points"])))
    return labels


@pytest.mark.parametrize("kind,n,size,batch,rounds", [("random", 700, 4, 40, False), ("chain", 400, 3, 30, True), ("star", 300, 5, 50, False), ("random", 500, 3, 10_000, True)])
def test_batches_solved_apart_give_the_plain_tree(spark, monkeypatch, kind, n, size, batch, rounds):
    if rounds:
        monkeypatch.setattr(T, "TASK_CLUSTERS", 0)
    edges, nodes = forest_of(kind, n, n), range(n + 2)
    df, ids = spark.createDataFrame(edges, FOREST), spark.createDataFrame([(v,) for v in nodes], "id long")
    got = {r.member_id: r.label for r in T.tree_labels(*T.condensed_tree(df, ids, size, 20.0, batch)).collect()}
    want = plain_tree(edges, list(nodes), size, 20.0)
    assert got == want and (kind == "star" or len(set(want.values())) > 3)


def test_parts_stay_small_and_weights_count_points(spark):
    edges = forest_of("random", 600, 9)
    rows, names, total, batches = T.split_forest(spark.createDataFrame(edges, FOREST), 50)
    assert total == len(edges) and batches == 12 and names.count() == len({v for e in edges for v in e[1:]})
    rows = rows.cache()
    assert rows.count() == total
    parts = connected_components(rows.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "a")
    own = rows.join(parts, "a").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("batch").alias("batches")).collect()
    assert max(r.n for r in own) <= 100 and {r.batches for r in own} == {1}
    # a subtree weighs the points that lighter edges connect
    by_rank = {r.rank: r for r in rows.collect()}
    order = sorted(by_rank)
    group = {v: {v} for e in edges for v in e[1:]}
    at_batch, first = {}, {by_rank[k].batch: i for i, k in reversed(list(enumerate(order)))}
    for i, (k, (_, a, b)) in enumerate(zip(order, sorted(edges))):
        if first[by_rank[k].batch] == i:
            at_batch = {v: len(s) for v, s in group.items()}
        assert sorted((by_rank[k].weight_a, by_rank[k].weight_b)) == sorted((at_batch[a], at_batch[b]))
        both = group[a] | group[b]
        group.update(dict.fromkeys(both, both))


def test_no_edges(spark):
    owners, clusters = T.condensed_tree(spark.createDataFrame([], FOREST), spark.createDataFrame([(1,), (2,)], "id long"), 2)
    assert {r.label for r in T.tree_labels(owners, clusters).collect()} == {-1}
