import random

from strandloom.operators import density as D

SCHEMA = "line3d_id long, x1 double, y1 double, x2 double, y2 double"


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(3)

    def boxes(first, n):
        out = []
        for i in range(first, first + n):
            x, y, size = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice((0.0, 0.1, 1.0, 9.0, 4000.0))
            out.append((i, x, y, x + size * rng.random(), y + size * rng.random()))
        return out

    a, b = boxes(0, 120), boxes(1000, 120)
    frame = lambda rows: spark.createDataFrame(rows, "id long, lx double, ly double, hx double, hy double")
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    for cell in (0.5, 20.0):
        rows = D.meeting_boxes(frame(a), frame(b), cell).select("a_id", "b_id").collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert D.meeting_boxes(frame(a), frame([]), 1.0).collect() == []


def test_a_far_outlier_makes_nobody_else_look_far(spark, monkeypatch):
    rng = random.Random(6)
    spots = [(0, 0), (6, 0), (0, 9), (30, 30)]
    lines = [(20 * s + i, *(v for _ in range(2) for v in (x + rng.uniform(0, 2), y + rng.uniform(0, 2)))) for s, (x, y) in enumerate(spots) for i in range(15)]
    counted = []

    def counting(*args, own=D.meeting_boxes):
        pairs = own(*args)
        counted.append(pairs.count())
        return pairs

    monkeypatch.setattr(D, "meeting_boxes", counting)
    monkeypatch.setattr(D, "FEW_ASKS", 10)
    totals, labels = [], []
    for rows in (lines, [*lines, (999, 1e4, 1e4, 1e4 + 1, 1e4)]):
        counted.clear()
        labels.append({r.member_id: r.label for r in D.planar_clusters(spark.createDataFrame(rows, SCHEMA), 5, reach=0.5).collect()})
        totals.append(sum(counted))
    assert totals[1] <= 2 * totals[0]
    assert labels[1].pop(999) == -1 and labels[0] == labels[1] and len(set(labels[0].values())) == 4


def test_lines_within_are_those_of_all_pairs_however_they_are_dealt(spark, monkeypatch):
    from strandloom.functions.geometry import line_distance
    from strandloom.operators import joins
    from pyspark.sql import functions as F

    rng = random.Random(8)
    lines = [(i, *(rng.uniform(-3, 3) for _ in range(4))) for i in range(90)] + [(100, 0.0, 0.0, 0.0, 0.0), (101, 0.1, 0.0, 0.1, 0.0), (102, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(lines, SCHEMA)
    ends = ("x1", "y1", "x2", "y2")
    a, b = (df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns)) for s in "ab")
    distance = line_distance(*(tuple(F.col(f"{s}_{c}") for c in ends) for s in "ab"))
    every = a.join(b, F.col("a_line3d_id") < F.col("b_line3d_id")).select("a_line3d_id", "b_line3d_id", distance.alias("d"))
    want = {(r[0], r[1]): r[2] for r in every.where("d <= 0.2").collect()}
    monkeypatch.setattr(D, "meeting_boxes", None)  # which makes a row for each pair of boxes that overlap
    for rows, block in ((1_000, 1 << 17), (20, 50)):
        monkeypatch.setattr(joins, "HOT_ROWS", rows)
        monkeypatch.setattr(D, "BLOCK", block)
        got = [tuple(r) for r in D.lines_within(df, 0.2).collect()]
        assert len(got) == len(want) and {r[:2]: r[2] for r in got} == want


def _planar_lines(rng, spots, each):
    return [(each * s + i, *(v for _ in range(2) for v in (x + rng.uniform(0, 2), y + rng.uniform(0, 2)))) for s, (x, y) in enumerate(spots) for i in range(each)]


def test_the_planar_tree_is_that_of_all_pairs_with_no_row_for_a_pair(spark, monkeypatch):
    from strandloom.functions.geometry import line_distance
    from strandloom.operators import joins
    from pyspark.sql import functions as F

    lines = _planar_lines(random.Random(9), [(0, 0), (5, 1), (40, 7)], 20) + [(90, 0.5, 0.5, 0.5, 0.5), (91, 0.5, 0.5, 0.5, 0.5)]
    df, k = spark.createDataFrame(lines, SCHEMA), 4
    ends = ("x1", "y1", "x2", "y2")
    a, b = (df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns)) for s in "ab")
    distance = line_distance(*(tuple(F.col(f"{s}_{c}") for c in ends) for s in "ab"))
    every = {(r[0], r[1]): r[2] for r in a.join(b, F.col("a_line3d_id") < F.col("b_line3d_id")).select("a_line3d_id", "b_line3d_id", distance).collect()}
    core = {n: sorted(d for p, d in every.items() if n in p)[k - 1] for n, *_ in lines}
    root, want = {n: n for n in core}, set()

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for d, i, j in sorted((max(d, core[i], core[j]), i, j) for (i, j), d in every.items()):
        if find(i) != find(j):
            root[find(i)] = find(j)
            want.add((d, i, j))
    monkeypatch.setattr(D, "meeting_boxes", None)  # which makes a row for each pair of boxes that overlap
    for rows, block in ((1_000, 1 << 17), (15, 40)):
        monkeypatch.setattr(joins, "HOT_ROWS", rows)
        monkeypatch.setattr(D, "BLOCK", block)
        cores = D.core_of_lines(df, k, 0.3, 200.0, 1.0)
        assert {r.id: r.core for r in cores.collect()} == core
        assert {tuple(r) for r in D.planar_forest(df, cores, 0.3, 200.0, 1.0).select("distance", "src", "dst").collect()} == want


def test_a_far_outlier_brings_no_more_lines_together_in_cells(spark, monkeypatch):
    lines, counted = _planar_lines(random.Random(6), [(0, 0), (6, 0)], 10), []

    def counting(*args, own=D._sides):
        sides = own(*args)
        counted.append(sum(a.join(b, ["grid", "cx", "cy"]).count() for a, b in sides))
        return sides

    monkeypatch.setattr(D, "_sides", counting)
    monkeypatch.setattr(D, "FEW_ASKS", 10)
    totals = []
    for rows in (lines, [*lines, (999, 1e4, 1e4, 1e4 + 1, 1e4)]):
        counted.clear()
        df = spark.createDataFrame(rows, SCHEMA)
        D.planar_forest(df, D.core_of_lines(df, 3, 0.5, 4e4, 1.0), 0.5, 4e4, 1.0).collect()
        totals.append(sum(counted))
    assert 0 < totals[1] <= 2 * totals[0]


def _embedded(spark, tmp_path, n=120, seed=12):
    """A folder whose embeddings are n lines."""
    rng = random.Random(seed)
    path = str(tmp_path / "scene")
    spark.createDataFrame([(i, [rng.gauss(0, 0.1) for _ in range(20)], i % 3) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_queries_over_near_lines_keep_no_row_for_a_pair(spark, tmp_path, monkeypatch):
    from strandloom.operators import joins
    from strandloom.plans import registry
    from strandloom.plans.analogs import Scene

    path, kept = _embedded(spark, tmp_path), []
    lines = D.ground_projection(Scene(spark, path).lines3d)
    pairs = D.lines_within(lines, registry.REACH).localCheckpoint()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = {
        "core_distance": rows(registry.rounded(D.core_distance(pairs, 3), "core")),
        "eps_components": rows(D.components_within(pairs, registry.REACH / 4)),
        "mutual_reachability": rows(registry.rounded(D.mutual_reachability(pairs, 3), "distance")),
        "pair_distance": rows(registry.rounded(pairs, "distance")),
    }

    def counting(df, *name, own):
        out = own(df, *name)
        kept.append(out.count())
        return out

    for module, name in ((D, "settled"), (D, "stored"), (registry, "settled")):
        if hasattr(module, name):
            monkeypatch.setattr(module, name, lambda df, *n, own=getattr(module, name): counting(df, *n, own=own))
    for few in (1_000, 10):
        monkeypatch.setattr(joins, "HOT_ROWS", few)
        for name, rows_ in want.items():
            kept.clear()
            assert rows(registry.QUERIES[name](spark, path)) == rows_ and rows_
            assert max(kept, default=0) < len(want["pair_distance"]) / 2


def test_lines_that_cross_far_from_their_ends_do_not_meet(spark, monkeypatch):
    rng = random.Random(14)
    lines, counted = [(i, rng.uniform(0, 2), rng.uniform(0, 20), rng.uniform(18, 20), rng.uniform(0, 20)) for i in range(150)], []

    def counting(*args, own=D._sides):
        sides = own(*args)
        counted.append(sum(a.join(b, ["grid", "cx", "cy"]).count() for a, b in sides))
        return sides

    monkeypatch.setattr(D, "_sides", counting)
    D.core_of_lines(spark.createDataFrame(lines, SCHEMA), 3, 0.1, 60.0, 0.25).collect()
    assert 0 < counted[0] < 150 * 150 / 2


def test_rounds_of_the_planar_tree_do_not_multiply_estimates(spark):
    lines = [(i, float(2**i), 0.0, float(2**i), 0.0) for i in range(24)]
    df = spark.createDataFrame(lines, SCHEMA)
    core = df.selectExpr("line3d_id AS id", "0.5D AS core")
    tree = D.planar_forest(df, core, 1.0, 2.0**26, 1.0)
    assert tree.count() == 23
    assert len(str(tree._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 30
