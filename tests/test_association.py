import itertools
import math
import random

import pytest
from strandloom.functions.geometry import line_distance
from strandloom.operators import association as A
from strandloom.operators import density as D
from strandloom.operators import visibility as V
from strandloom.operators import voting as O


def test_overlap_and_neighbours(spark):
    tracks = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 1), (2, 2, 2)], "point3d_id long, pos int, cam_id long")
    got = {(r.cam_a, r.cam_b): r.matches for r in A.view_overlap(tracks).collect()}
    assert got == {(1, 1): 8, (1, 2): 3, (2, 1): 3, (2, 2): 4}
    near = [(r.cam_id, r.rank, r.neighbour_id) for r in A.neighbours(A.view_overlap(tracks), 1).orderBy("cam_id").collect()]
    assert near == [(1, 1, 1), (2, 1, 2)]


def test_last_match_wins(spark):
    res = spark.createDataFrame([(0, 0, 5, 7), (1, 0, 5, 7), (1, 1, 5, 9), (1, 0, 6, 2)], "line3d_id long, proj_pos int, cam_id long, seg_id long")
    assert {(r.cam_id, r.seg_id): r.line3d_id for r in A.segment_to_line(res).collect()} == {(5, 7): 1, (5, 9): 1, (6, 2): 1}
    assert {(r.line3d_id, r.cam_id): r.seg_id for r in A.line_to_segment(res).collect()} == {(0, 5): 7, (1, 5): 9, (1, 6): 2}
    assert sorted(map(tuple, A.correspondence(res).collect())) == [(5, 7, 6, 2), (5, 9, 6, 2), (6, 2, 5, 9)]
    masks = spark.createDataFrame([(5, 7, 30), (5, 9, 20)], "cam_id long, seg_id long, mask_id long")
    assert [tuple(r) for r in A.direct_line_mask(res, masks).collect()] == [(5, 1, 20)]


def test_instance_ties(spark):
    res = spark.createDataFrame([(1, 0, s) for s in range(3)] + [(2, 0, s) for s in range(3, 7)], "line3d_id long, cam_id long, seg_id long")
    gt = spark.createDataFrame([(0, s, m) for s, m in enumerate([7, 7, 9, 9, 9, 7, 7])], "cam_id long, seg_id long, mask_id long")
    assert {r.line3d_id: r.instance_id for r in A.ground_truth(res, gt).collect()} == {1: 7, 2: 7}


def votes(spark, seen_in_2):
    res = [(10, 0, 0, 0), (11, 0, 0, 1), (10, 0, 1, 2), (11, 0, 1, 3)] + [(line, 0, 2, 4 + i) for i, (line, _) in enumerate(seen_in_2)]
    masks = [(0, 0, 1), (0, 1, 1), (1, 2, 4), (1, 3, 4)] + [(2, 4 + i, m) for i, (_, m) in enumerate(seen_in_2)]
    near = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 2)], "cam_id long, rank int, neighbour_id long")
    return O.mask_votes(spark.createDataFrame(res, "line3d_id long, proj_pos int, cam_id long, seg_id long"), spark.createDataFrame(masks, "cam_id long, seg_id long, mask_id long"), near)


def test_votes(spark):
    one = votes(spark, [])
    assert [tuple(r) for r in O.accepted_masks(one).collect()] == [(0, 1)]
    edges = sorted(map(tuple, O.mask_edges(one).collect()))
    assert edges == [(0, 1, 1, 4), (1, 4, 0, 1)]
    parts = sorted((r.cam_id, r.mask_id) for r in O.mask_components(O.mask_edges(one)).collect())
    assert parts == [(0, 1), (1, 4)]
    two = votes(spark, [(10, 8), (11, 9)])
    assert O.accepted_masks(two).collect() == [] and O.mask_edges(two).collect() == []


@pytest.mark.parametrize("point, seen", [((0.26, 0.26, 2.6), True), ((0.05, 0.05, 0.5), False)])
def test_visible_and_hidden(spark, point, seen):
    names = ["cam_id long", "width double", "height double", "fx double", "fy double", *(f"r{i}{j} double" for i in range(3) for j in range(3)), *(f"t{i} double" for i in range(3))]
    cameras = spark.createDataFrame([(0, 100.0, 100.0, 100.0, 100.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)], ", ".join(names))
    lines = spark.createDataFrame([(4, 0.1, 0.1, 1.0, 0.3, 0.3, 3.0)], "line3d_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    observed = spark.createDataFrame([(0, *point)], "cam_id long, x double, y double, z double")
    out = V.visible_lines(lines, cameras, observed).collect()
    assert len(out) == seen
    if seen:
        assert [round(v, 9) for v in tuple(out[0])[2:]] == [10, 10, 10, 10]


def apart(p, a, b):
    n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = 0 if n == 0 else max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / n))
    return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))


def plain_distance(m, n):
    (a, b), (c, d) = (m[:2], m[2:]), (n[:2], n[2:])
    return min(apart(a, c, d), apart(b, c, d), apart(c, a, b), apart(d, a, b))


def test_line_distance(spark):
    from pyspark.sql import functions as F

    lit = lambda v: tuple(F.lit(float(x)) for x in v)
    row = spark.range(1).select(line_distance(lit((0, 0, 4, 0)), lit((2, 3, 2, 5))).alias("a"), line_distance(lit((0, 0, 4, 0)), lit((2, -1, 2, 3))).alias("b"), line_distance(lit((1, 1, 1, 1)), lit((1, 1, 1, 1))).alias("c")).first()
    assert tuple(row) == (3, 1, 0)


def test_grid_finds_all_near_pairs(spark):
    rng = random.Random(1)
    lines = [(i, *(rng.uniform(-3, 3) for _ in range(2))) for i in range(60)]
    lines = [(i, x, y, x + rng.gauss(0, 1), y + rng.gauss(0, 1)) for i, x, y in lines] + [(99, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(lines, "line3d_id long, x1 double, y1 double, x2 double, y2 double")
    for most in (0.05, 0.4, 3.0):
        want = {(a[0], b[0]) for a, b in itertools.combinations(lines, 2) if plain_distance(a[1:], b[1:]) <= most}
        rows = D.lines_within(df, most).collect()
        assert len(rows) == len(want) and {(r.src, r.dst) for r in rows} == want


def test_overlap_of_many_tracks_gets_more_tasks(spark, monkeypatch):
    from strandloom.operators import joins

    tracks = spark.createDataFrame([(p, k, (p * 7 + k * k) % 9) for p in range(30) for k in range(4)], "point3d_id long, pos long, cam_id long")
    want = sorted(map(tuple, A.view_overlap(tracks).collect()))
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    got = A.view_overlap(tracks)
    assert got.rdd.getNumPartitions() > 12 and sorted(map(tuple, got.collect())) == want


def test_rows_meet_neighbours_with_a_list_and_not_once_for_each(spark, monkeypatch):
    import random

    from strandloom.operators import joins

    rng = random.Random(4)
    views, met = range(12), []
    near = [(a, b) for a in views for b in rng.sample(views, 7) if a != b]
    res = [(rng.choice((1, 1, 1, 2, 3, 4)), n % 5, rng.choice(views), n) for n in range(160)]
    masks = [(c, s, s % 9) for _, _, c, s in res]
    frame = spark.createDataFrame(res, "line3d_id long, proj_pos long, cam_id long, seg_id long")
    seg_mask = spark.createDataFrame(masks, "cam_id long, seg_id long, mask_id long")
    last = {}
    for line, pos, cam, seg in res:
        last[line, cam] = max(last.get((line, cam), (-1, -1)), (pos, seg))
    want = sorted((c, s, b, last[line, b][1]) for line, _, c, s in res for a, b in near if a == c and (line, b) in last)
    seen = {}
    for line, _, c, s in res:
        for a, b in near:
            if a == c and (line, b) in last:
                seen.setdefault((c, s % 9, b), set()).add(last[line, b][1] % 9)
    votes = {(c, m, b): (0, None) for c, _, m in masks for a, b in near if a == c} | {k: (len(v), min(v)) for k, v in seen.items()}

    def counting(many, few, *args, own=joins.dealt):
        met.append(many.count())
        return own(many, few, *args)

    monkeypatch.setattr(A, "dealt", counting)
    ranked = spark.createDataFrame([(a, 2, b) for a, b in near], "cam_id long, rank int, neighbour_id long")
    for hot in (1_000, 10):
        monkeypatch.setattr(joins, "HOT_ROWS", hot)
        monkeypatch.setattr(joins, "TASK_ROWS", 10 * hot)
        got = A.correspondence(frame, spark.createDataFrame(near, "src_cam long, tgt_cam long")).collect()
        assert sorted(map(tuple, got)) == want
        assert {tuple(r)[:3]: tuple(r)[3:] for r in O.mask_votes(frame, seg_mask, ranked).collect()} == votes
        cast = O.votes_cast(frame, seg_mask, ranked)
        assert {tuple(r)[:3]: tuple(r)[3:] for r in cast.collect()} == {k: v for k, v in votes.items() if v[0]}
        every = O.mask_votes(frame, seg_mask, ranked)
        assert sorted(O.mask_edges(cast).collect()) == sorted(O.mask_edges(every).collect())
    assert met and max(met) <= len(res)
