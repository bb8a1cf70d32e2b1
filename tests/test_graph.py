import itertools
import random

import pytest
from pyspark.sql import functions as F
from strandloom.operators import density as D
from strandloom.operators import graph as C
from strandloom.plans import pipelines as P


def blocks(n_blocks=4, size=8):
    """Cliques with single links between them."""
    edges = [(b * 100 + i, b * 100 + j, 3) for b in range(n_blocks) for i, j in itertools.combinations(range(size), 2)]
    return edges + [(b * 100, (b + 1) * 100, 1) for b in range(n_blocks - 1)]


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster_id, set()).add(r.member_id)
    return sorted(map(sorted, out.values()))


def planted(n_blocks=4, size=8, extra=()):
    return sorted([sorted(b * 100 + i for i in range(size)) for b in range(n_blocks)] + [[e] for e in extra])


def test_cooccurrence_cases(spark):
    rows = [(0, 1, 10), (0, 2, 10), (0, 3, 11), (1, 1, 12), (1, 2, 12), (1, 3, 12), (2, 1, 13), (2, 2, 13)]
    lm = spark.createDataFrame(rows, "cam_id long, line3d_id long, mask_id long")
    weights = {(r.src, r.dst): r.weight for r in C.cooccurrence(lm).collect()}
    assert weights == {(1, 2): 3, (1, 3): 1, (2, 3): 1}
    shares = {(r.src, r.dst): r.weight for r in C.normalised(C.cooccurrence(lm), lm).collect()}
    assert shares == {(1, 2): 1.0, (1, 3): 0.5, (2, 3): 0.5}
    assert groups(C.strict_clusters(lm, 3)) == [[1, 2], [3]]
    assert groups(C.strict_clusters(lm, 1)) == [[1, 2, 3]]
    with pytest.raises(ValueError, match="no method"):
        P.clusters_by("nothing", lm)


def test_communities_are_found(spark):
    edges = spark.createDataFrame(blocks(), "src long, dst long, weight long")
    nodes = spark.createDataFrame([(n,) for n in {x for a, b, _ in blocks() for x in (a, b)} | {999}], "id long")
    found = C.leiden(nodes, edges)
    assert groups(found) == planted(extra=[999])
    q = C.modularity(found, edges).first().modularity
    whole = C.modularity(nodes.select(F.lit(0).alias("cluster_id"), F.col("id").alias("member_id")), edges).first().modularity
    assert q > 0.6 > abs(whole)
    assert groups(C.label_propagation(nodes, edges)) == planted(extra=[999])
    assert groups(C.leiden(nodes, edges.limit(0))) == [[n.id] for n in nodes.orderBy("id").collect()]


def plain_propagation(nodes, edges, rounds=20):
    near = {n: {} for n in nodes}
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    label = {n: n for n in nodes}
    for _ in range(rounds):
        before = dict(label)
        for parity in (0, 1):
            new = dict(label)
            for n in nodes:
                if n % 2 == parity and near[n]:
                    votes = {}
                    for m, w in near[n].items():
                        votes[label[m]] = votes.get(label[m], 0) + w
                    new[n] = min(votes, key=lambda k: (-votes[k], k))
            label = new
        if label == before:
            break
    return label


def test_propagation_matches_a_plain_loop(spark):
    rng = random.Random(2)
    edges = sorted({(min(a, b), max(a, b), rng.randint(1, 3)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a != b} , key=lambda e: e[:2])
    edges = list({e[:2]: e for e in edges}.values())
    nodes = list(range(42))
    out = C.label_propagation(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long, weight long"))
    assert {r.member_id: r.cluster_id for r in out.collect()} == plain_propagation(nodes, edges)


def test_walks_follow_edges(spark):
    edges = spark.createDataFrame(blocks(2, 4), "src long, dst long, weight long")
    nodes = spark.createDataFrame([(n,) for n in (0, 1, 100, 999)], "id long")
    walks = C.random_walks(nodes, edges, walks=3, length=12).collect()
    linked = {frozenset(e[:2]) for e in blocks(2, 4)}
    assert len(walks) == 12
    for w in walks:
        assert w.path[0] == w.start
        assert w.path == [999] if w.start == 999 else len(w.path) == 12 and all(frozenset(p) in linked for p in zip(w.path, w.path[1:]))


def test_density_clusters(spark):
    rng = random.Random(1)
    points = [(i, rng.gauss(0, 0.1)) for i in range(30)] + [(100 + i, 5 + rng.gauss(0, 0.1)) for i in range(30)] + [(500, 12.5), (501, -6.0)]
    pairs = [(a, b, abs(x - y)) for (a, x), (b, y) in itertools.combinations(points, 2)]
    df = spark.createDataFrame(pairs, "src long, dst long, distance double")
    labels = {r.member_id: r.label for r in D.density_clusters(df, 5).collect()}
    assert labels[500] == labels[501] == -1
    assert sum(labels[i] == 0 for i in range(30)) >= 20 and sum(labels[100 + i] == 100 for i in range(30)) >= 20
    forest = D.spanning_forest(df).collect()
    assert len(forest) == len(points) - 1
    order = sorted(x for _, x in points)
    assert sum(r.distance for r in forest) == pytest.approx(order[-1] - order[0])


def plain_density(pairs, nodes, size, k, far=None):
    """Labels from explicit trees: every cluster is a set of points and the levels at which they leave it."""
    near = {n: [] for n in nodes}
    for a, b, d in pairs:
        near[a].append((d, b))
        near[b].append((d, a))
    core = {n: sorted(v)[k - 1][0] for n, v in near.items() if len(v) >= k}
    edges = sorted((max(d, core[a], core[b]), a, b) for a, b, d in pairs if a in core and b in core)
    tree = {n: (n, None, None, frozenset([n])) for n in nodes}  # name, level, children, points
    for d, a, b in edges:
        x, y = tree[a], tree[b]
        if x[3] == y[3]:
            continue
        both = (None, 1 / max(d, 1e-12), (x, y), x[3] | y[3])
        for n in both[3]:
            tree[n] = both
    tops = [t for t in {id(t): t for t in tree.values()}.values() if len(t[3]) >= size]
    labels = dict.fromkeys(nodes, -1)

    def walk(node, birth):
        """(stability, best below, chosen point sets below) of the cluster that starts here."""
        leaves, below, sets, at = {}, 0.0, [], node
        while True:
            big = [c for c in at[2] if len(c[3]) >= size]
            leaves.update({n: at[1] for c in at[2] if len(c[3]) < size or len(big) == 2 for n in c[3]})
            if len(big) != 1:
                break
            at = big[0]
        if len(big) == 2:
            for c in big:
                own, deeper, chosen = walk(c, at[1])
                below += max(own, deeper)
                sets += [c[3]] if own >= deeper else chosen
        return sum(v - birth for v in leaves.values()), below, sets

    for t in tops:
        own, below, sets = walk(t, 1 / far if far else 0.0)
        for group in [t[3]] if len(tops) > 1 and own >= below else sets:
            labels.update(dict.fromkeys(group, min(group)))
    return labels


@pytest.mark.parametrize("seed,far,batch", [(1, 9.0, None), (2, None, 7), (3, 9.0, 25), (4, 4.0, 1000)])
def test_density_over_several_parts_matches_a_plain_tree(spark, seed, far, batch):
    rng = random.Random(seed)
    pairs, nodes = {}, list(range(140))
    for part in range(6):
        own = nodes[part * 20 : part * 20 + rng.choice((3, 12, 20))]
        for a, b in itertools.combinations(own, 2):
            if rng.random() < 0.6:
                pairs[a, b] = float(rng.randint(1, 3)) if part % 2 else rng.uniform(0.5, 3.5)
    rows = [(a, b, d) for (a, b), d in pairs.items()]
    df, ids = spark.createDataFrame(rows, "src long, dst long, distance double"), spark.createDataFrame([(n,) for n in nodes], "id long")
    got = {r.member_id: r.label for r in D.density_clusters(df, 5, 2, ids, far, batch).collect()}
    assert got == plain_density(rows, nodes, 5, 2, far)


def test_disjoint_cliques_are_clusters(spark):
    cliques = [(b * 100 + i, b * 100 + j, 1.0) for b in range(2) for i, j in itertools.combinations(range(30), 2)]
    df = spark.createDataFrame(cliques, "src long, dst long, distance double")
    labels = {r.member_id: r.label for r in D.density_clusters(df, 5).collect()}
    assert {labels[i] for i in range(30)} == {0} and {labels[100 + i] for i in range(30)} == {100}
    one = D.density_clusters(df.where("src < 100"), 5)
    assert {r.label for r in one.collect()} == {-1}


def test_planar_clusters_do_not_depend_on_the_first_reach(spark):
    rng = random.Random(5)
    spots = [(0, 0), (3, 0), (40, 40)]
    lines = [(10 * s + i, x + rng.uniform(0, 0.5), y + rng.uniform(0, 0.5), x + rng.uniform(0, 0.5), y + rng.uniform(0, 0.5)) for s, (x, y) in enumerate(spots) for i in range(9)] + [(99, -30.0, 5.0, -30.0, 5.0)]
    df = spark.createDataFrame(lines, "line3d_id long, x1 double, y1 double, x2 double, y2 double")
    pairs = [(r.src, r.dst, r.distance) for r in D.lines_within(df, 1000.0).collect()]
    assert len(pairs) == 28 * 27 // 2
    want = plain_density(pairs, [r[0] for r in lines], 5, 5)
    for reach in (0.05, 200.0):
        assert {r.member_id: r.label for r in D.planar_clusters(df, 5, reach=reach).collect()} == want
    assert len(set(want.values())) >= 3


def test_neighbours_of_vectors_are_found(spark):
    """Of the true nearest neighbours at least nine in ten, for clustered vectors and for plain Gaussian ones."""
    import numpy as np

    rng = np.random.default_rng(4)
    spots = rng.normal(size=(40, 64)) * 2
    for vectors in (np.concatenate([spots[rng.integers(40, size=1500)] + rng.normal(size=(1500, 64)) * 0.5]), rng.normal(size=(600, 16))):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
        found = {(r.src, r.dst) for r in D.embedded_neighbours(df).select("src", "dst").collect()}
        x = (vectors - vectors.mean(0)) / vectors.std(0)
        near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2) if len(x) < 700 else np.stack([((x - v) ** 2).sum(1) for v in x])
        np.fill_diagonal(near, np.inf)
        truth = [(i, int(j)) for i in range(len(x)) for j in np.argsort(near[i])[:3]]
        assert sum((min(p), max(p)) in found for p in truth) >= 0.9 * len(truth)


def test_walks_from_a_hub_follow_the_weights(spark, monkeypatch):
    monkeypatch.setattr(C, "RANGE_ROWS", 4)
    star = [(0, i, 1 if i < 40 else 60) for i in range(1, 41)]
    walks = C.random_walks(spark.createDataFrame([(0,)], "id long"), spark.createDataFrame(star, "src long, dst long, weight long"), walks=600, length=2).collect()
    ends = [w.path[1] for w in walks]
    assert len(ends) == 600 and 0.5 < ends.count(40) / 600 < 0.7 and len(set(ends)) > 30


def test_common_views_are_counted_where_pairs_are_made(spark):
    rows = [(c, n, (n * 7 + c * c) % 5) for c in range(12) for n in range(20) if (n * c) % 3 != 1]
    lm = spark.createDataFrame(rows, "cam_id long, line3d_id long, mask_id long")
    seen, masks = {}, {}
    for c, n, m in rows:
        seen.setdefault(n, set()).add(c)
        masks.setdefault(n, set()).add((c, m))
    want = {(a, b, len(masks[a] & masks[b]), len(seen[a] & seen[b])) for a in seen for b in seen if a < b and masks[a] & masks[b]}
    for got in (C.covisible_pairs(lm), C.covisible(C.cooccurrence(lm), lm)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "array_intersect" in plan  # one row a pair meets the lists; no row for each view of each pair
        assert {tuple(r) for r in got.collect()} == want
    assert {(r.src, r.dst): r.weight for r in C.normalised_pairs(lm).collect()} == {(a, b): w / n for a, b, w, n in want}


def test_shuffles_of_many_rows_get_more_tasks(spark, monkeypatch):
    from strandloom.operators import joins

    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    lm = spark.createDataFrame([(0, n, 0) for n in range(20)], "cam_id long, line3d_id long, mask_id long")
    pairs = C.cooccurrence(lm)
    assert pairs.rdd.getNumPartitions() == 19 and pairs.count() == 190


def test_line_masks_and_pairs_get_tasks_by_their_rows_and_are_made_once(spark, monkeypatch):
    from strandloom.operators import association as A
    from strandloom.operators import graph as C
    from strandloom.operators import joins
    from strandloom.plans import registry

    rng = random.Random(11)
    res = [(rng.randrange(8), n, rng.randrange(5), n) for n in range(120)]
    frame = spark.createDataFrame(res, "line3d_id long, proj_pos long, cam_id long, seg_id long")
    masks = spark.createDataFrame([(c, s, s % 2) for _, _, c, s in res], "cam_id long, seg_id long, mask_id long")
    plain = {tuple(r) for r in A.direct_line_mask(frame, masks).collect()}
    edges = {tuple(r) for r in C.cooccurrence(A.direct_line_mask(frame, masks)).collect()}
    made = []

    def counting(*args, own=C._shared_masks):
        made.append(args)
        return own(*args)

    monkeypatch.setattr(C, "_shared_masks", counting)
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    direct = A.direct_line_mask(frame, masks)
    assert direct.rdd.getNumPartitions() == 12 and {tuple(r) for r in direct.collect()} == plain
    assert {tuple(r) for r in C.cooccurrence(direct).collect()} == edges
    clusters, kept = C.strict_graph(direct, 2)
    assert {tuple(r) for r in kept.collect()} == {e for e in edges if e[2] >= 2}
    assert {tuple(r) for r in clusters.collect()} == {tuple(r) for r in C.strict_clusters(direct, 2).collect()}
    monkeypatch.setattr(joins, "TASK_ROWS", 1_000_000)
    made.clear()
    registry.QUERIES["partition_modularity"](spark, "/root/testdata/sf0.001").collect()
    assert len(made) == 1


def test_many_pairs_go_in_packs(spark, monkeypatch):
    """Packed or joined, of any size of tasks, pairs and their common views are the same; packs hold far less than rows."""
    from strandloom.operators import joins, packed_pairs

    rng = random.Random(21)
    rows = [(c - 5, n * 97 - 700, rng.randrange(3) + c) for c in range(14) for n in range(30) if rng.random() < 0.7]
    rows += [(40, n * 97 - 700, None) for n in range(0, 30, 2)] + [(None, 5, 1), (None, 6, 1), (41, None, 1), (41, 7, 1)]
    lm = spark.createDataFrame(rows, "cam_id long, line3d_id long, mask_id int")
    seen, masks = {}, {}
    for c, n, m in rows:
        if c is not None and n is not None:
            seen.setdefault(n, set()).add(c)
            if m is not None:
                masks.setdefault(n, set()).add((c, m))
    want = sorted((a, b, len(masks[a] & masks[b]), len(seen[a] & seen[b])) for a in masks for b in masks if a < b and masks[a] & masks[b])
    assert sorted(map(tuple, C.covisible_pairs(lm).collect())) == want
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    made = []
    monkeypatch.setattr(packed_pairs, "summed", lambda packs, n, own=packed_pairs.summed: own(made.append(packs) or packs, n))
    for sizes in ({}, {"MASK_LINES": 7, "PAIRS": 25, "BYTES": 50}):
        for name, value in sizes.items():
            monkeypatch.setattr(packed_pairs, name, value)
        got = C.covisible_pairs(lm)
        assert sorted(map(tuple, got.collect())) == want and got.dtypes == [("src", "bigint"), ("dst", "bigint"), ("weight", "bigint"), ("common", "bigint")]
    assert sum(len(r.pack) for r in made[0].collect()) < 8 * sum(w[2] for w in want)


def test_numbers_come_back_from_their_bytes():
    import numpy as np
    import pyarrow as pa
    from strandloom.operators import packed_pairs as K

    lists = [[-(2**62), -5, 0, 127, 128, 2**61], [3], [2**40, 2**40 + 1], list(range(-300, 300, 7))]
    batch = pa.record_batch({"line3d_id": pa.array(range(4), pa.int64()), "views": pa.array(lists, pa.list_(pa.int64()))})
    (packed,) = K.packed_lists([batch])
    views, counts = K._unpacked(packed.column("views"))
    assert counts.tolist() == [len(x) for x in lists] and views.tolist() == [v for x in lists for v in x]
    assert K._numbers(np.zeros(0, np.uint8))[0].tolist() == []


def test_packs_do_not_depend_on_the_sizes_of_batches_and_blocks(monkeypatch):
    import pyarrow as pa
    from strandloom.operators import packed_pairs as K

    rng, rows = random.Random(23), []
    seen = {n: sorted(rng.sample(range(12), rng.randrange(4, 12))) for n in range(-20, 20)}
    for n, views in seen.items():
        rows += [(c, (n * c) % 3, n) for c in views]
    rows.sort(key=lambda r: r[:2])
    masks = {n: {(c, m) for c, m, k in rows if k == n} for n in seen}
    want = sorted((a, b, len(masks[a] & masks[b]), len(set(seen[a]) & set(seen[b]))) for a in seen for b in seen if a < b and masks[a] & masks[b])

    def got(size):
        lists = [pa.record_batch({"line3d_id": pa.array([r[2] for r in rows]), "views": pa.array([seen[r[2]] for r in rows], pa.list_(pa.int64()))})]
        views = next(K.packed_lists(lists)).column("views")
        whole = pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows]) for i in range(3)), views], ["cam_id", "mask_id", "line3d_id", "views"])
        packs = [p for b in K.pairs_of_masks(5)(whole.slice(i, size) for i in range(0, len(rows), size)) for p in b.to_pylist()]
        packs.sort(key=lambda p: p["bucket"])
        sums = K.summed_pairs([pa.RecordBatch.from_pylist([p]) for p in packs])
        return sorted(tuple(r.values()) for b in sums for r in b.to_pylist())

    assert got(1_000) == want
    for pairs, size in ((40, 7), (3, 1)):
        monkeypatch.setattr(K, "PAIRS", pairs)
        monkeypatch.setattr(K, "BYTES", 300)
        assert got(size) == want
