"""Queries over the given tables and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.values import coerced, leaves
from ..operators import association as A
from ..operators import density as D
from ..operators import graph as C
from ..operators import overlay as K
from ..operators import raster as R
from ..operators import visibility as V
from ..operators import voting as O
from ..session import settled, shared_dir
from ..sources import scene_files as S
from ..sources import sparse_model as M
from . import pipelines as P
from .analogs import HEIGHT, WIDTH, Scene, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
VIEWS = 3
#: Reach of planar neighbourhoods.
REACH = 0.2


def query(oracle: str | None = None, *needs: str):
    def register(make: Callable[[Scene], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Scene(spark, sf_dir))
        if oracle:
            ORACLE_SQL[make.__name__] = sql(oracle, *needs)
        return make

    return register


def _direct(s: Scene) -> DataFrame:
    return A.direct_line_mask(s.residuals, s.seg_mask())


def _edges(s: Scene, views: int = VIEWS) -> DataFrame:
    return settled(C.cooccurrence(_direct(s), views))


def _clusters(s: Scene) -> DataFrame:
    return C.strict_clusters(_direct(s), VIEWS)


def _nodes(s: Scene) -> DataFrame:
    return _direct(s).select(F.col("line3d_id").alias("id")).distinct()


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in names})


@query("SELECT cam_id, seg_id, line3d_id FROM s2l", "res", "s2l")
def seg_to_line3d(s):
    return A.segment_to_line(s.residuals)


@query("SELECT line3d_id, cam_id, seg_id FROM l2s", "res", "l2s")
def line3d_to_seg(s):
    return A.line_to_segment(s.residuals)


@query("SELECT s.cam_id AS src_cam, s.seg_id AS src_seg, t.cam_id AS tgt_cam, t.seg_id AS tgt_seg FROM s2l s JOIN near n ON n.cam_id = s.cam_id AND n.rank > 1 JOIN l2s t ON t.line3d_id = s.line3d_id AND t.cam_id = n.neighbour_id", "s2l", "l2s", "near")
def correspondence(s):
    near = A.neighbours(A.view_overlap(s.tracks)).where("rank > 1").select(F.col("cam_id").alias("src_cam"), F.col("neighbour_id").alias("tgt_cam"))
    return A.correspondence(s.residuals, near)


@query("SELECT cam_id, line3d_id, mask_id FROM direct", "direct")
def line_mask_direct(s):
    return _direct(s)


@query("SELECT cam_id, mask_id, count(DISTINCT seg_id) AS n, string_agg(DISTINCT CAST(seg_id AS VARCHAR), ',' ORDER BY CAST(seg_id AS VARCHAR)) AS segments FROM seg GROUP BY 1, 2", "seg")
def mask_to_segments(s):
    own = A.mask_groups(s.seg_mask())
    return own.select("cam_id", "mask_id", F.size("segments").cast("long").alias("n"), F.array_join(F.sort_array(F.transform("segments", lambda x: x.cast("string"))), ",").alias("segments"))


@query("SELECT cam_id, count(DISTINCT mask_id) AS masks, min(mask_id) AS lowest, max(mask_id) AS highest FROM seg GROUP BY 1", "seg")
def view_mask_ids(s):
    """How many different masks a view has, and their range."""
    return A.distinct_masks(s.seg_mask())


@query("SELECT cam_id, seg_id, max(mask_id) AS mask_id FROM seg GROUP BY 1, 2", "seg")
def segment_to_mask(s):
    return s.seg_mask().groupBy("cam_id", "seg_id").agg(F.max("mask_id").alias("mask_id"))


@query("SELECT src, dst, weight FROM pairs", "pairs")
def cooccur_pairs(s):
    return C.cooccurrence(_direct(s))


@query("SELECT src, dst, weight FROM edges", "edges")
def cooccur_edges_min3(s):
    return C.cooccurrence(_direct(s), VIEWS)


_COMMON = "SELECT e.src, e.dst, e.weight, count(*) AS common FROM pairs e JOIN (SELECT DISTINCT cam_id, line3d_id FROM direct) a ON a.line3d_id = e.src JOIN (SELECT DISTINCT cam_id, line3d_id FROM direct) b ON b.line3d_id = e.dst AND b.cam_id = a.cam_id GROUP BY 1, 2, 3"


@query(_COMMON, "pairs", "direct")
def covisible_edges(s):
    return C.covisible_pairs(_direct(s))


@query(f"SELECT src, dst, round(weight / common, 6) AS weight FROM ({_COMMON})", "pairs", "direct")
def normalized_weights(s):
    return rounded(C.normalised_pairs(_direct(s)), "weight")


@query("SELECT cluster_id, member_id FROM clusters", "links", "clusters")
def components_min3(s):
    return _clusters(s)


@query("SELECT cluster_id, count(*) AS size FROM clusters GROUP BY 1", "links", "clusters")
def component_sizes(s):
    return C.cluster_sizes(_clusters(s))


@query("SELECT cluster_id, member_id FROM clusters WHERE cluster_id IN (SELECT cluster_id FROM clusters GROUP BY 1 HAVING count(*) > 1)", "links", "clusters")
def clusters_gt1(s):
    return C.larger_clusters(_clusters(s))


@query("SELECT count(*) AS clusters, CAST(sum(CASE WHEN size > 1 THEN 1 ELSE 0 END) AS BIGINT) AS larger, CAST(sum(size) AS BIGINT) AS members FROM (SELECT cluster_id, count(*) AS size FROM clusters GROUP BY 1)", "links", "clusters")
def cluster_summary(s):
    return C.cluster_summary(_clusters(s))


@query("SELECT cam_a, cam_b, matches FROM overlap", "overlap")
def view_overlap(s):
    return A.view_overlap(s.tracks)


@query("SELECT cam_id, rank, neighbour_id, matches FROM near", "near")
def neighbours_topk(s):
    return A.neighbours(A.view_overlap(s.tracks))


@query("SELECT n.cam_id AS cam_a, n.neighbour_id AS cam_b, a.point3d_id, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM near n JOIN last_ a ON a.cam_id = n.cam_id JOIN last_ b ON b.cam_id = n.neighbour_id AND b.point3d_id = a.point3d_id WHERE n.rank > 1".replace("last_", "(SELECT * FROM (SELECT l_suppkey AS cam_id, l_orderkey AS point3d_id, l_quantity AS x, l_extendedprice AS y, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1)"), "near")
def common_points(s):
    pairs = A.neighbours(A.view_overlap(s.tracks)).where("rank > 1").select(F.col("cam_id").alias("cam_a"), F.col("neighbour_id").alias("cam_b"))
    return A.common_points(s.features, pairs)


@query("SELECT l_suppkey AS cam_id, round((max(l_quantity) - min(l_quantity)) * (max(l_extendedprice) - min(l_extendedprice)), 4) AS area FROM lineitem GROUP BY 1")
def bbox_area(s):
    return rounded(A.bounding_area(s.features), "area", places=4)


def _near_views(s: Scene) -> DataFrame:
    return settled(A.neighbours(A.view_overlap(s.tracks)))


def _votes(s: Scene) -> DataFrame:
    return settled(O.votes_cast(s.residuals, s.seg_mask(fine=True), _near_views(s)))


@query("SELECT cam_id, mask_id, neighbour_id, vote, seen_mask FROM votes", "votes")
def mask_votes(s):
    return O.mask_votes(s.residuals, s.seg_mask(fine=True), _near_views(s))


@query("SELECT cam_id, mask_id FROM accepted", "accepted")
def accepted_masks(s):
    return O.accepted_masks(_votes(s))


@query("SELECT cam_a, mask_a, cam_b, mask_b FROM medges", "medges")
def mask_edges(s):
    return O.mask_edges(_votes(s))


@query("SELECT low AS cluster_id, id >> 32 AS cam_id, id & 4294967295 AS mask_id FROM mask_part", "mask_part")
def mask_components(s):
    return O.mask_components(O.mask_edges(_votes(s)))


@query("SELECT DISTINCT r.low AS cluster_id, s.line3d_id AS member_id FROM mask_part r JOIN fine f ON (f.cam_id << 32) | f.mask_id = r.id JOIN s2l s ON s.cam_id = f.cam_id AND s.seg_id = f.seg_id", "mask_part", "fine", "s2l")
def voting_line_clusters(s):
    return P.voting_pipeline(s.residuals, s.seg_mask(fine=True), s.tracks)


@query("SELECT line3d_id, instance_id FROM (SELECT line3d_id, mask_id AS instance_id, row_number() OVER (PARTITION BY line3d_id ORDER BY count(*) DESC, mask_id) AS k FROM res JOIN fine USING (cam_id, seg_id) GROUP BY line3d_id, mask_id) WHERE k = 1", "res", "fine")
def gt_instance(s):
    return A.ground_truth(s.residuals, s.seg_mask(fine=True))


@query("SELECT cam_id, " + ", ".join(f"round(a{i}{j}, 6) + 0.0 AS a{i}{j}" for i in range(3) for j in range(3)) + " FROM rot", "rot")
def quat_to_rot(s):
    r = G.rotation(*(F.col(f"q{i}") for i in range(4)))
    names = [f"a{i}{j}" for i in range(3) for j in range(3)]
    return rounded(s.poses.select("cam_id", *(r[int(n[1])][int(n[2])].alias(n) for n in names)), *names)


@query("SELECT cam_id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("r00", "r01", "r02", "r10", "r11", "r12", "r20", "r21", "r22", "t0", "t1", "t2")) + " FROM cams", "cams")
def camera_pose(s):
    names = [*(f"r{i}{j}" for i in range(3) for j in range(3)), "t0", "t1", "t2"]
    return rounded(s.cameras.select("cam_id", *names), *names)


@query("SELECT cam_id, " + ", ".join(f"round(s * {c}, 6) + 0.0 AS {c}" for c in ("w", "x", "y", "z")) + " FROM (SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END AS s FROM q)", "q")
def rot_to_quat(s):
    """Back from the rotation: the unit quaternion whose first part is not negative."""
    r = G.rotation(*(F.col(f"q{i}") for i in range(4)))
    return rounded(s.poses.select("cam_id", *(c.alias(n) for c, n in zip(G.quaternion(r), "wxyz"))), *"wxyz")


@query("SELECT min(least(x1, x2)) AS low_x, max(greatest(x1, x2)) AS high_x, min(least(y1, y2)) AS low_y, max(greatest(y1, y2)) AS high_y FROM (SELECT round(x1, 6) AS x1, round(x2, 6) AS x2, round(y1, 6) AS y1, round(y2, 6) AS y2 FROM lines3d)", "lines3d")
def axis_ranges(s):
    """The box around the lines on the ground."""
    return rounded(D.axis_ranges(D.ground_projection(s.lines3d)), "low_x", "high_x", "low_y", "high_y")


@query("SELECT cam_id, mask_id, min(row) AS top, max(row) AS bottom, min(col) AS left_, max(col) AS right_, count(*) AS area FROM (SELECT cam_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, mask_id FROM cover) GROUP BY 1, 2", "cover")
def mask_extracts(s):
    """Each mask of the merged image by itself: its box and area there."""
    return R.extracts(R.mask_cover(s.mask_runs))


@query("SELECT cam_id, seg_id, row, col FROM pix", "pix")
def raster_pixels(s):
    return R.raster_pixels(s.segments, HEIGHT, WIDTH)


@query("SELECT cam_id, row, col, seg_id FROM owner", "owner")
def raster_owner(s):
    return R.raster_owner(R.raster_pixels(s.segments, HEIGHT, WIDTH))


def _on_masks(s: Scene) -> DataFrame:
    owner = R.raster_owner(R.raster_pixels(s.segments, HEIGHT, WIDTH))
    return owner.join(R.mask_cover(s.mask_runs), ["cam_id", "row", "col"], "left").withColumn("mask_id", F.coalesce("mask_id", F.lit(R.BACKGROUND)))


_BEST = "SELECT cam_id, seg_id, mask_id, n_px FROM (SELECT *, row_number() OVER (PARTITION BY cam_id, seg_id ORDER BY n_px DESC, mask_id) AS k FROM onmask {}) WHERE k = 1 AND mask_id <> -1"


@query(_BEST.format("WHERE mask_id <> -1"), "onmask")
def seg_mask_argmax(s):
    return R.majority_mask(_on_masks(s), "cam_id", "seg_id", background=False)


@query(_BEST.format(""), "onmask")
def projected_majority(s):
    return R.majority_mask(_on_masks(s), "cam_id", "seg_id", background=True)


@query("SELECT p.cam_id, p.seg_id, CAST(p.row AS INTEGER) AS row, CAST(p.col AS INTEGER) AS col, coalesce(r.mask_id, -1) AS mask_id FROM owner p LEFT JOIN runs r ON r.cam_id = p.cam_id AND r.row = p.row AND p.col BETWEEN r.c0 AND r.c1", "owner", "runs")
def pixels_on_masks(s):
    return R.pixels_on_masks(R.raster_owner(R.raster_pixels(s.segments, HEIGHT, WIDTH)), s.mask_runs)


@query("SELECT cam_id, row, col, mask_id FROM cover", "cover")
def mask_cover(s):
    return R.mask_cover(s.mask_runs)


@query("SELECT cam_id, mask_id, area FROM area", "area")
def mask_area(s):
    return R.mask_area(s.mask_runs)


@query("SELECT c.cam_id, c.row, c.col, coalesce(n.new_id, c.mask_id) AS mask_id FROM cover c LEFT JOIN (SELECT m.cam_id, m.row, m.col, CAST(max(k) + 999 AS BIGINT) AS new_id FROM mpix m JOIN (SELECT cam_id, mask_id, row_number() OVER (PARTITION BY cam_id ORDER BY lpad(CAST(mask_id AS VARCHAR), 12, '0')) AS k FROM (SELECT DISTINCT cam_id, mask_id FROM mpix WHERE mask_id % 3 = 0)) f USING (cam_id, mask_id) GROUP BY 1, 2, 3) n USING (cam_id, row, col)", "cover", "mpix")
def gt_override(s):
    """Every third mask is a ground-truth patch over the merged image."""
    patches = R.run_pixels(s.mask_runs.where("mask_id % 3 = 0")).select("cam_id", F.lpad(F.col("mask_id").cast("string"), 12, "0").alias("file"), "row", "col")
    return R.overridden(R.mask_cover(s.mask_runs), patches)


@query("SELECT cam_id, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, mask_id FROM cover JOIN (SELECT unnest(range(30)) AS r) ON least(r * 48 // 30, 47) = row JOIN (SELECT unnest(range(100)) AS c) ON least(c * 64 // 100, 63) = col", "cover")
def nearest_resize(s):
    return R.resized(R.mask_cover(s.mask_runs), (HEIGHT, WIDTH), (30, 100))


@query("SELECT c.cam_id, c.row, c.col, c.mask_id FROM cover c WHERE (SELECT count(*) FROM cover d WHERE d.cam_id = c.cam_id AND d.mask_id = c.mask_id AND abs(d.row - c.row) + abs(d.col - c.col) = 1) < 4", "cover")
def mask_outline(s):
    return R.outline(R.mask_cover(s.mask_runs)).select("cam_id", "row", "col", "mask_id")


@query()
def mask_merge(s):
    return R.merged_masks(s.mask_runs)


@query("SELECT cam_id, line3d_id, round(y1, 6) AS y1, round(x1, 6) AS x1, round(y2, 6) AS y2, round(x2, 6) AS x2 FROM seen_lines", "seen_lines")
def visible_lines(s):
    return rounded(V.visible_lines(s.lines3d, s.cameras, s.observed), "y1", "x1", "y2", "x2")


@query("SELECT cam_id, line3d_id FROM occ", "occ")
def occluded_lines(s):
    return V.occluded_lines(s.lines3d, s.cameras, s.observed)


@query("SELECT cam_id, line3d_id, mask_id, 'direct' AS how FROM direct UNION ALL SELECT cam_id, line3d_id, mask_id, 'projected' AS how FROM projected ANTI JOIN direct USING (cam_id, line3d_id)", "direct", "projected")
def line_mask_full(s):
    views = V.visible_lines(s.lines3d, s.cameras, s.observed)
    pixels = R.mask_cover(s.mask_runs).withColumnRenamed("cam_id", "place")
    return A.full_line_mask(_direct(s), P.projected_line_mask(views, pixels, HEIGHT, WIDTH, s.poses.select("cam_id", "place")))


@query("SELECT round(min(least(z1, z2)) + 0.1, 6) AS ground_z FROM lines3d", "lines3d")
def ground_plane(s):
    return rounded(D.ground_plane(s.lines3d), "ground_z")


@query("SELECT line3d_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM lines3d", "lines3d")
def ground_project(s):
    return rounded(D.ground_projection(s.lines3d), "x1", "y1", "x2", "y2")


@query("SELECT src, dst, round(distance, 6) + 0.0 AS distance FROM planar", "planar")
def pair_distance(s):
    return rounded(D.lines_within(D.ground_projection(s.lines3d), REACH), "distance")


@query("SELECT id, round(core, 6) + 0.0 AS core FROM core", "core")
def core_distance(s):
    return rounded(D.core_within(D.ground_projection(s.lines3d), 3, REACH), "core")


@query(
    "SELECT src, dst, round(greatest(distance, ca, cb), 6) + 0.0 AS distance FROM (SELECT src, dst, distance, max(core) FILTER (at_src) AS ca, max(core) FILTER (NOT at_src) AS cb FROM "
    "(SELECT p.src, p.dst, p.distance, p.at_src, c.core FROM (SELECT *, unnest([true, false]) AS at_src FROM planar) p JOIN core c ON c.id = CASE WHEN p.at_src THEN p.src ELSE p.dst END) GROUP BY src, dst, distance) WHERE ca IS NOT NULL AND cb IS NOT NULL",
    "planar",
    "core",
)
def mutual_reachability(s):
    return rounded(D.lines_within(D.ground_projection(s.lines3d), REACH, 3), "distance")


@query("SELECT id AS node, low AS component FROM line_reach", "line_reach")
def eps_components(s):
    return D.line_components(D.ground_projection(s.lines3d), REACH / 4)


@query("SELECT src, dst, round((SELECT max(weight) FROM edges) - weight + 1e-6, 6) AS distance FROM edges", "edges")
def similarity_distance(s):
    return rounded(D.similarity_distance(_edges(s)), "distance")


@query("SELECT round((SELECT sum(weight) FROM ends WHERE ca = cb) / w - d2 / (4 * w * w), 6) AS modularity FROM (SELECT (SELECT sum(weight) FROM edges)::DOUBLE AS w, (SELECT sum(d * d) FROM (SELECT cluster_id, sum(weight) AS d FROM links JOIN clusters ON member_id = src GROUP BY 1))::DOUBLE AS d2)".replace("FROM ends", "FROM (SELECT weight, a.cluster_id AS ca, b.cluster_id AS cb FROM edges JOIN clusters a ON a.member_id = src JOIN clusters b ON b.member_id = dst)"), "links", "edges", "clusters")
def partition_modularity(s):
    return rounded(C.modularity(*C.strict_graph(_direct(s), VIEWS)), "modularity")


@query("SELECT event_id, CAST(CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN v END AS BIGINT) AS whole, CAST(CASE WHEN NOT regexp_full_match(v, '[+-]?[0-9]+') AND regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN v END AS DOUBLE) AS number, CASE WHEN NOT regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN v END AS text FROM (SELECT event_id, json_extract_string(props, '$.k') AS v FROM events)")
def json_coerce(s):
    whole, number, text = coerced(F.get_json_object("props", "$.k"))
    return s.table("events").select("event_id", whole.alias("whole"), number.alias("number"), text.alias("text"))


@query("SELECT label AS cluster_id, id AS member_id FROM spread WHERE turn = 40", "nodes", "links", "spread")
def label_propagation_clusters(s):
    return P.whispers(_direct(s))


@query()
def leiden(s):
    return P.leiden(_direct(s))


@query()
def leiden_normalized(s):
    return P.leiden_normalised(_direct(s))


@query()
def similarity_hdbscan(s):
    return P.similarity_density(_direct(s))


@query()
def node2vec_hdbscan(s):
    return P.walks_density(_direct(s))


@query()
def planar_hdbscan(s):
    """The pipeline's own cluster size; the first radius only says where to begin."""
    return P.distance_pipeline(s.lines3d, 10, reach=REACH)


@query("SELECT c.cluster_id, c.member_id, round(l.x1, 6) AS x1, round(l.y1, 6) AS y1, round(l.z1, 6) AS z1, round(l.x2, 6) AS x2, round(l.y2, 6) AS y2, round(l.z2, 6) AS z2 FROM clusters c JOIN lines3d l ON l.line3d_id = c.member_id", "links", "clusters", "lines3d")
def cluster_lines(s):
    """The lines of every cluster, as a viewer would draw them."""
    return rounded(P.drawn(_clusters(s), s.lines3d).drop("red", "green", "blue"), "x1", "y1", "z1", "x2", "y2", "z2")


def _text_folder(s: Scene, name: str, lines: DataFrame) -> str:
    path = f"{shared_dir(s.spark)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


@query("SELECT CAST(c_custkey AS INTEGER) AS camera_id, 'PINHOLE' AS model, 640 + c_nationkey AS width, CAST(480 AS BIGINT) AS height, round(abs(c_acctbal), 2) AS fx, round(abs(c_acctbal) + 1, 2) AS fy FROM customer".replace("640 + c_nationkey", "CAST(640 + c_nationkey AS BIGINT)"))
def intrinsics_text(s):
    """Cameras written as a text model and read back."""
    line = F.concat_ws(" ", "c_custkey", F.lit("PINHOLE"), F.lit(640) + F.col("c_nationkey"), F.lit(480), F.round(F.abs("c_acctbal"), 2), F.round(F.abs("c_acctbal") + 1, 2), F.lit("320"), F.lit("240"))
    got = M.read_intrinsics_text(s.spark, _text_folder(s, "cameras", s.table("customer").select(line.alias("value"))))
    return got.select("camera_id", "model", "width", "height", F.col("params")[0].alias("fx"), F.col("params")[1].alias("fy"))


@query("SELECT l_orderkey AS point3d_id, l_linenumber - 1 AS pos, CAST(l_suppkey AS INTEGER) AS cam_id FROM (SELECT l_orderkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS INTEGER) AS l_linenumber FROM lineitem)")
def points_text(s):
    """Tracks written as a text model and read back, one row an observation."""
    seen = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))), lambda x: F.concat_ws(" ", x["l_suppkey"], x["l_linenumber"]))
    rows = s.table("lineitem").groupBy("l_orderkey").agg(F.array_join(seen, " ").alias("track"))
    line = F.concat_ws(" ", "l_orderkey", F.lit("0.5 1.5 2.5 1 2 3 0.25"), "track")
    return M.tracks(M.read_points_text(s.spark, _text_folder(s, "points", rows.select(line.alias("value")))))


@query("SELECT l_suppkey AS cam_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_extendedprice, l_orderkey) - 1 AS INTEGER) AS pos, l_orderkey AS point3d_id, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem".replace("SELECT l_suppkey AS", "SELECT CAST(l_suppkey AS INTEGER) AS", 1))
def images_text(s):
    """Posed images with their features (two lines an image) written as a text model and read back."""
    seen = F.sort_array(F.collect_list(F.struct("l_quantity", "l_extendedprice", "l_orderkey")))
    rows = s.table("lineitem").groupBy("l_suppkey").agg(F.array_join(F.transform(seen, lambda x: F.concat_ws(" ", x["l_quantity"], x["l_extendedprice"], x["l_orderkey"])), " ").alias("seen"))
    line = F.concat(F.concat_ws(" ", "l_suppkey", F.lit("1 0 0 0 0.5 0.25 2 1"), F.concat(F.lit("view"), "l_suppkey", F.lit(".png"))), F.lit("\n"), "seen")
    return M.features(M.read_images_text(s.spark, _text_folder(s, "images", rows.select(line.alias("value")))))


def _binary_folder(s: Scene, name: str, rows: DataFrame, schema: str) -> str:
    path = f"{shared_dir(s.spark)}/{name}-{uuid.uuid4().hex}"
    M.write_binary(rows, path, schema)
    return path


@query("SELECT CAST(c_custkey AS INTEGER) AS camera_id, 'PINHOLE' AS model, 640 + c_nationkey AS width, CAST(480 AS BIGINT) AS height, round(abs(c_acctbal), 2) AS fx, round(abs(c_acctbal) + 1, 2) AS fy FROM customer".replace("640 + c_nationkey", "CAST(640 + c_nationkey AS BIGINT)"))
def intrinsics_binary(s):
    """Cameras written as a binary model and read back."""
    focal = F.round(F.abs("c_acctbal"), 2).cast("double")
    params = F.array(focal, F.round(F.abs("c_acctbal") + 1, 2).cast("double"), F.lit(320.0), F.lit(240.0))
    rows = s.table("customer").select(F.col("c_custkey").cast("int").alias("camera_id"), F.lit("PINHOLE").alias("model"), (F.lit(640) + F.col("c_nationkey")).cast("bigint").alias("width"), F.lit(480).cast("bigint").alias("height"), params.alias("params"))
    got = M.read_intrinsics(s.spark, _binary_folder(s, "cameras", rows, M.INTRINSICS))
    return got.select("camera_id", "model", "width", "height", F.col("params")[0].alias("fx"), F.col("params")[1].alias("fy"))


@query("SELECT l_orderkey AS point3d_id, l_linenumber - 1 AS pos, CAST(l_suppkey AS INTEGER) AS cam_id FROM (SELECT l_orderkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS INTEGER) AS l_linenumber FROM lineitem)")
def points_binary(s):
    """Tracks written as a binary model and read back, one row an observation."""
    seen = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))), lambda x: F.struct(x["l_suppkey"].cast("int").alias("image_id"), x["l_linenumber"].cast("int").alias("point2d_idx")))
    fixed = [F.array(*map(F.lit, (0.5, 1.5, 2.5))).alias("xyz"), F.array(*map(F.lit, (1, 2, 3))).alias("rgb"), F.lit(0.25).alias("error")]
    rows = s.table("lineitem").groupBy(F.col("l_orderkey").alias("point3d_id")).agg(seen.alias("track")).select("*", *fixed)
    return M.tracks(M.read_points(s.spark, _binary_folder(s, "points", rows, M.POINTS)))


@query("SELECT l_suppkey AS cam_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_extendedprice, l_orderkey) - 1 AS INTEGER) AS pos, l_orderkey AS point3d_id, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem".replace("SELECT l_suppkey AS", "SELECT CAST(l_suppkey AS INTEGER) AS", 1))
def images_binary(s):
    """Posed images with their features written as a binary model and read back."""
    seen = F.sort_array(F.collect_list(F.struct("l_quantity", "l_extendedprice", "l_orderkey")))
    features = F.transform(seen, lambda x: F.struct(x["l_quantity"].cast("double").alias("x"), x["l_extendedprice"].cast("double").alias("y"), x["l_orderkey"].cast("bigint").alias("point3d_id")))
    fixed = [F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))).alias("qvec"), F.array(*map(F.lit, (0.5, 0.25, 2.0))).alias("tvec"), F.lit(1).alias("camera_id"), F.concat(F.lit("view"), "image_id", F.lit(".png")).alias("name")]
    rows = s.table("lineitem").groupBy(F.col("l_suppkey").cast("int").alias("image_id")).agg(features.alias("features")).select("*", *fixed)
    return M.features(M.read_images(s.spark, _binary_folder(s, "images", rows, M.IMAGES)))


@query(
    "SELECT CAST(p.first + j AS BIGINT) AS line3d_id, CAST(row_number() OVER (PARTITION BY p.part, j ORDER BY l_suppkey, l_orderkey, l_linenumber) - 1 AS INTEGER) AS proj_pos, CAST(l_suppkey AS INTEGER) AS cam_id, CAST(l_orderkey * 10 + l_linenumber AS INTEGER) AS seg_id, p.part + j / 4 AS x1 "
    "FROM (SELECT *, unnest(range(n)) AS j FROM (SELECT part, n, sum(n) OVER (ORDER BY part) - n AS first FROM (SELECT DISTINCT l_partkey AS part, 1 + l_partkey % 3 AS n FROM lineitem))) p JOIN lineitem ON l_partkey = p.part"
)
def lines3d_text(s):
    """3D lines and the residuals they share written as text and read back: a row a part, with one to three lines."""
    seen = F.sort_array(F.collect_list(F.struct("l_suppkey", "l_orderkey", "l_linenumber")))
    rows = s.table("lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("m"), F.array_join(F.transform(seen, lambda x: F.concat_ws(" ", x["l_suppkey"], x["l_orderkey"] * 10 + x["l_linenumber"], F.lit("0 0 1 1"))), " ").alias("seen"))
    n = 1 + F.col("part") % 3
    ends = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.concat_ws(" ", F.col("part") + j / 4, F.lit("0 0 1 1 1"))), " ")
    path = _text_folder(s, "lines", rows.orderBy("part").select(F.concat_ws(" ", n, ends, "m", "seen").alias("value")))
    lines, residuals = S.read_lines3d(s.spark, path)
    return residuals.join(lines.select("line3d_id", "x1"), "line3d_id").select("line3d_id", "proj_pos", "cam_id", "seg_id", "x1")


_CANVAS = "(SELECT DISTINCT cam_id, row, col FROM (SELECT DISTINCT CAST(label AS BIGINT) AS cam_id FROM emb), (SELECT CAST(unnest(range(48)) AS INTEGER) AS row), (SELECT CAST(unnest(range(64)) AS INTEGER) AS col))"


def _images(s: Scene) -> DataFrame:
    return s.segments.select("cam_id").distinct()


@query(
    "SELECT v.cam_id, v.row, v.col, "
    + ", ".join(f"CASE WHEN e.row IS NOT NULL THEN 0 ELSE CAST(floor({255 * (1 - K.MASK_ALPHA)!r}::DOUBLE + coalesce(c.mask_id * {step} % {prime} + 50, 200) * 0.7::DOUBLE) AS INTEGER) END AS {name}" for name, step, prime in (("red", 37, 199), ("green", 53, 193), ("blue", 71, 191)))
    + f" FROM {_CANVAS} v LEFT JOIN cover c USING (cam_id, row, col) LEFT JOIN (SELECT DISTINCT cam_id, row, col FROM edge_pixels) e ON e.cam_id = v.cam_id AND e.row = v.row AND e.col = v.col",
    "emb", "cover", "edge_pixels",
)
def mask_overlay(s):
    """Every image with its masks in colours and their outer outlines in black."""
    return K.mask_overlay(R.mask_cover(s.mask_runs), _images(s), HEIGHT, WIDTH)


@query(
    "SELECT v.cam_id, v.row, v.col, "
    + ", ".join(f"CAST(coalesce(t.seg_mask * {step} % {prime}, round_even({200 * (1 - K.FILL_ALPHA)!r}::DOUBLE + coalesce(f.mask_id * {step} % {prime}, 200) * 0.3::DOUBLE, 0)) AS INTEGER) AS {name}" for name, step, prime in (("red", 37, 149), ("green", 53, 139), ("blue", 71, 131)))
    + f" FROM {_CANVAS} v LEFT JOIN (SELECT * FROM cover SEMI JOIN seg_owner o ON o.cam_id = cover.cam_id AND o.mask_id = cover.mask_id) f ON f.cam_id = v.cam_id AND f.row = v.row AND f.col = v.col "
    "LEFT JOIN (SELECT w.cam_id, w.row, w.col, o.mask_id AS seg_mask FROM (SELECT p.cam_id, p.row + CASE WHEN steep THEN 0 ELSE more END AS row, p.col + CASE WHEN steep THEN more ELSE 0 END AS col, max(p.seg_id) AS seg_id "
    "FROM pix p SEMI JOIN seg_owner so ON so.cam_id = p.cam_id AND so.seg_id = p.seg_id JOIN (SELECT seg_id, abs(r1 - r0) > abs(c1 - c0) AS steep FROM segs) d ON d.seg_id = p.seg_id, (SELECT unnest([0, 1]) AS more) GROUP BY 1, 2, 3) w JOIN seg_owner o ON o.cam_id = w.cam_id AND o.seg_id = w.seg_id) t ON t.cam_id = v.cam_id AND t.row = v.row AND t.col = v.col",
    "emb", "cover", "seg_owner", "pix", "segs",
)
def association_overlay(s):
    """Every image with the masks that segments lie on, and the segments in their masks' colours."""
    own = settled(R.majority_mask(_on_masks(s), "cam_id", "seg_id", background=False))
    return K.association_overlay(R.mask_cover(s.mask_runs), s.segments, own, _images(s), HEIGHT, WIDTH)


@query("SELECT v.cam_id, v.row, v.col, " + ", ".join(f"CAST(coalesce(c.mask_id * {step} % {prime} + 50, 0) AS INTEGER) AS {name}" for name, step, prime in (("red", 37, 199), ("green", 53, 193), ("blue", 71, 191))) + f" FROM {_CANVAS} v LEFT JOIN cover c USING (cam_id, row, col)", "emb", "cover")
def instance_overlay(s):
    return K.instance_colours(R.mask_cover(s.mask_runs), _images(s), HEIGHT, WIDTH)


@query("SELECT cam_id, count(DISTINCT mask_id) AS objects, cam_id || '_' || count(DISTINCT mask_id) || 'objs.png' AS name FROM cover GROUP BY 1", "cover")
def overlay_names(s):
    return K.object_names(R.mask_cover(s.mask_runs), _images(s))



@query(
    "SELECT event_id, '$.a.k' AS path, CAST(json_extract_string(props, '$.k') AS BIGINT) AS whole, CAST(NULL AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS BOOLEAN) AS truth FROM events "
    "UNION ALL SELECT event_id, '$.b[0]', user_id, NULL, NULL, NULL FROM events UNION ALL SELECT event_id, '$.b[1]', NULL, value, NULL, NULL FROM events UNION ALL SELECT event_id, '$.b[2]', NULL, NULL, event_type, NULL FROM events "
    "UNION ALL SELECT event_id, '$.b[3]', NULL, NULL, NULL, user_id % 2 = 0 FROM events UNION ALL SELECT event_id, '$.b[4][0].c d', NULL, value, NULL, NULL FROM events UNION ALL SELECT event_id, '$.7', NULL, NULL, NULL, NULL FROM events"
)
def json_leaves(s):
    """Nested objects and lists made of each event, coerced down to every leaf."""
    parts = ['{"a": ', F.col("props"), ', "b": ["', F.col("user_id").cast("string"), '", "', F.col("value").cast("string"), '", "', F.col("event_type"), '", ', (F.col("user_id") % 2 == 0).cast("string"), ', [{"c d": ', F.col("value").cast("string"), '}, {}]], "7": null}']
    return leaves(s.table("events").select("event_id", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("nested")), "event_id", "nested")


@query(
    "SELECT l.line3d_id, coalesce(k.cluster_id, -1) AS cluster_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, "
    + ", ".join(f"CAST(coalesce(k.cluster_id * {step} % {prime} + 50, 128) AS INTEGER) AS {name}" for name, step, prime in (("red", 37, 199), ("green", 53, 193), ("blue", 71, 191)))
    + ", CASE WHEN k.cluster_id IS NULL THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS alpha FROM lines3d l LEFT JOIN (SELECT cluster_id, member_id FROM clusters WHERE cluster_id IN (SELECT cluster_id FROM clusters GROUP BY 1 HAVING count(*) > 1)) k ON k.member_id = l.line3d_id",
    "lines3d", "links", "clusters",
)
def projected_plot(s):
    """Every line on the ground in the colour of its cluster; lines in none are noise."""
    return rounded(P.projected_clusters(D.ground_projection(s.lines3d), C.larger_clusters(_clusters(s))), "x1", "y1", "x2", "y2")


@query()
def embedding_plane(s):
    """Every embedding on the two directions of most variance."""
    return rounded(P.plane_of_vectors(s.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))), "u", "v")
