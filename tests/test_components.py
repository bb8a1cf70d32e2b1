import random

from strandloom.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    edges += [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5050)] + [(7, 7), (9000, 9000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    df = spark.createDataFrame([(None, 3)], "src long, dst long")
    assert connected_components(df).collect() == []
