from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, v array<double>, d string, block string"


def brute(rows, positives=5, negatives=10):
    """Anchors are the rows whose id is divisible by 100."""
    fit = [(i, label, [floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and isfinite(x) for x in v)]
    out = []
    for i, label, q in fit:
        if i % 100:
            continue
        scored = sorted((-min(max(sum(a * b for a, b in zip(q, o)), -(2**63)), 2**63 - 1), j, other) for j, other, o in fit if len(o) == len(q) and j != i)
        for p, pid, _ in [x for x in scored if x[2] == label][:positives]:
            found = [(-s, j) for s, j, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(i, pid, rank + 1, j, -p, s) for rank, (s, j) in enumerate(found[:negatives])]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, label, v, "x", "y") for i, label, v in rows], SCHEMA)
    out = H.hard_negatives(df, F.col("vec_id") % 100 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def test_matches_brute_force_with_a_large_label_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        label = 0 if i % 3 == 0 else int(rng.integers(1, 12))
        v = np.round(rng.normal(size=8) * 2) / 4 if i % 2 else np.full(8, 0.25)  # many equal scores
        rows.append((i, label, v.tolist()))
    want = brute(rows)
    assert len(want) > 200
    assert got(spark, rows, block_rows=64, group_rows=4) == want
    assert got(spark, rows) == want


def test_close_groups_and_windows(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 32))
    rows = [(i, int(rng.integers(0, 4)), (base[i % 20] + 0.4 * rng.normal(size=32)).astype(float).tolist()) for i in range(800)]
    assert got(spark, rows, block_rows=128) == brute(rows)


def test_odd_rows(spark):
    v, w = [0.5, -0.25, 1.0], [0.25, 0.0, 0.5]
    rows = [(0, 1, v), (0, 1, v), (1, 1, v), (2, 1, w), (3, 2, w), (3, 2, w), (4, None, w), (5, 2, None), (6, 2, []), (7, 2, [0.1, None, 0.2]), (8, 2, [float("nan"), 1.0, 1.0]), (9, 2, [float("-inf"), 1.0, 1.0])]
    rows += [(None, 2, w), (10, 2, [0.25, 0.0]), (100, 5, v), (200, 1, [0.0, 0.0, 0.0]), (300, 1, [-1.0, 0.0, -1.0]), (400, 7, [1e17, 0.0, 0.0]), (11, 7, [1e17, 1.0, 0.0]), (12, 8, [3e16, 0.0, 0.0]), (13, 8, [0.0, 1e16, 0.0])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


@pytest.mark.parametrize("seed", range(4))
def test_lists_stop_early_and_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    rows = np.floor(256 * rng.normal(size=(3000, 4)))
    rows[:, 3] = 0
    anchor = np.floor(256 * rng.normal(size=4))
    ids, allowed = rng.permutation(3000).astype(np.int64), rng.random(3000) < 0.7
    scored, lists = [], H.Lists(rows)
    plain = H.Lists.scores
    lists.scores = lambda at, a: scored.append(len(at)) or plain(lists, at, a)
    score = (rows @ anchor).astype(np.int64)
    top = int(np.sort(score)[-20])
    for low, high in ((H._LOW, H._HIGH), (top // 3, top), (0, 0)):
        scored.clear()
        ((s, i),) = lists.sought(anchor, allowed, ids, [(low, high)], 10)
        want = sorted((-x, y) for x, y, ok in zip(score.tolist(), ids.tolist(), allowed) if ok and low <= x <= high)[:10]
        assert list(zip((-s).tolist(), i.tolist())) == want
        if low == H._LOW:
            assert sum(scored) < 0.5 * allowed.sum()
