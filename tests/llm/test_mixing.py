from collections import defaultdict

from strandloom.llm import mixing as M


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies string, place int")


def water(sizes):
    """Targets by resharing the excess until none is above."""
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_targets_copies_and_edges(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "hot" if i % 3 else f"s{i % 9}", "x", 1) for i in range(400)]
    rows += [(900, None, None, None, None), (901, "two words", None, None, None), (902, "", "void", None, None), (7, "w " * 10, "hot", "x", 1), (None, "a b", "hot", None, None)]
    df = docs(spark, rows)
    plan = M.planned(df.select("source", M.words(df.text).alias("size"), "doc_id"))
    got = plan.collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    want = water(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 3 * 40
    assert sorted(map(tuple, plan.collect()), key=repr) == sorted(map(tuple, got), key=repr)
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in got)


def test_empty(spark):
    df = docs(spark, [])
    assert M.mixed_documents(df).collect() == []
