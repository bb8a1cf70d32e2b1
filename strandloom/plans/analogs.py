"""The engine's relations, derived from the star-schema and embedding tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEIGHT, WIDTH = 48, 64


class Scene:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def residuals(self) -> DataFrame:
        """A part is a 3D line, a supplier a view, an order line a segment."""
        return self.table("lineitem").select(F.col("l_partkey").alias("line3d_id"), F.col("l_suppkey").alias("cam_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seg_id"), F.col("l_orderkey").alias("proj_pos"))

    def seg_mask(self, fine: bool = False) -> DataFrame:
        period = F.year("l_shipdate") * 12 + F.month("l_shipdate") if fine else F.year("l_shipdate")
        mask = (period * 10 + F.col("l_linenumber")).cast("long")
        return self.table("lineitem").select(F.col("l_suppkey").alias("cam_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seg_id"), mask.alias("mask_id"))

    @property
    def tracks(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("point3d_id"), F.col("l_linenumber").alias("pos"), F.col("l_suppkey").alias("cam_id"))

    @property
    def features(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("cam_id"), F.col("l_orderkey").alias("point3d_id"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))

    def _parts(self, *columns) -> DataFrame:
        """Embedding elements (counted from 1) as doubles e1 to e20."""
        own = self.table("embeddings").select("vec_id", "label", *(F.get("embedding", F.lit(i - 1)).cast("double").alias(f"e{i}") for i in range(1, 21)))
        return own.select(*columns) if columns else own

    @property
    def lines3d(self) -> DataFrame:
        return self._parts(F.col("vec_id").alias("line3d_id"), *((F.col(f"e{i}") * 10).alias(c) for i, c in enumerate(("x1", "y1", "z1", "x2", "y2", "z2"), 1)))

    @property
    def poses(self) -> DataFrame:
        """(cam_id, q0..q3, t_0..t_2): quaternion of unit length, translation."""
        n = F.sqrt(sum((F.col(f"e{i}") * F.col(f"e{i}") for i in range(8, 11)), F.col("e7") * F.col("e7")))
        return self._parts(F.col("vec_id").alias("cam_id"), F.col("label").cast("long").alias("place"), *((F.col(f"e{i}") / n).alias(f"q{i - 7}") for i in range(7, 11)), *(F.col(f"e{i}").alias(f"p{i - 11}") for i in range(11, 14)))

    @property
    def cameras(self) -> DataFrame:
        from ..functions.geometry import pose

        r, t = pose(tuple(F.col(f"q{i}") for i in range(4)), tuple(F.col(f"p{i}") for i in range(3)))
        size = [F.lit(v).alias(c) for v, c in ((100.0, "width"), (80.0, "height"), (60.0, "fx"), (60.0, "fy"))]
        return self.poses.select("cam_id", "place", *size, *(r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), *(t[i].alias(f"t{i}") for i in range(3)))

    @property
    def observed(self) -> DataFrame:
        """(place, x, y, z): the points that all cameras of a place observe."""
        return self._parts(F.col("label").cast("long").alias("place"), *((F.col(f"e{i}") * 10).alias(c) for i, c in ((14, "x"), (15, "y"), (16, "z"))))

    @property
    def segments(self) -> DataFrame:
        """(cam_id, seg_id, y1, x1, y2, x2): a place is a view, an embedding a segment; some ends lie outside the image."""
        return self._parts(F.col("label").cast("long").alias("cam_id"), F.col("vec_id").alias("seg_id"), *((F.col(f"e{i}") * f + g).alias(c) for i, c, f, g in ((14, "y1", 96.0, 24.0), (15, "x1", 128.0, 32.0), (16, "y2", 96.0, 24.0), (17, "x2", 128.0, 32.0))))

    @property
    def mask_runs(self) -> DataFrame:
        """(cam_id, mask_id, row, c0, c1): a rectangle for each embedding."""
        top = F.pmod(F.floor(F.abs(F.col("e18")) * 960), F.lit(HEIGHT - 8)).cast("int")
        left = F.pmod(F.floor(F.abs(F.col("e19")) * 1280), F.lit(WIDTH - 8)).cast("int")
        size = (F.pmod(F.floor(F.abs(F.col("e20")) * 640), F.lit(6)) + 2).cast("int")
        own = self._parts(F.col("label").cast("long").alias("cam_id"), F.col("vec_id").alias("mask_id"), top.alias("top"), left.alias("c0"), (left + size).alias("c1"), size.alias("size"))
        return own.select("cam_id", "mask_id", F.explode(F.sequence("top", F.col("top") + F.col("size"))).alias("row"), "c0", "c1")


#: The same relations for DuckDB.
RELATIONS = {
    "res": "SELECT l_partkey AS line3d_id, l_suppkey AS cam_id, l_orderkey * 10 + l_linenumber AS seg_id, l_orderkey AS proj_pos FROM lineitem",
    "seg": "SELECT l_suppkey AS cam_id, l_orderkey * 10 + l_linenumber AS seg_id, year(l_shipdate) * 10 + l_linenumber AS mask_id FROM lineitem",
    "fine": "SELECT l_suppkey AS cam_id, l_orderkey * 10 + l_linenumber AS seg_id, (year(l_shipdate) * 12 + month(l_shipdate)) * 10 + l_linenumber AS mask_id FROM lineitem",
    "s2l": "SELECT cam_id, seg_id, max(line3d_id) AS line3d_id FROM res GROUP BY cam_id, seg_id",
    "l2s": "SELECT line3d_id, cam_id, seg_id FROM (SELECT *, row_number() OVER (PARTITION BY line3d_id, cam_id ORDER BY proj_pos DESC, seg_id DESC) AS k FROM res) WHERE k = 1",
    "direct": "SELECT cam_id, line3d_id, mask_id FROM (SELECT cam_id, line3d_id, mask_id, row_number() OVER (PARTITION BY cam_id, line3d_id ORDER BY seg_id DESC, mask_id DESC) AS k FROM seg JOIN s2l USING (cam_id, seg_id)) WHERE k = 1",
    "pairs": "SELECT a.line3d_id AS src, b.line3d_id AS dst, count(*) AS weight FROM direct a JOIN direct b ON a.cam_id = b.cam_id AND a.mask_id = b.mask_id AND a.line3d_id < b.line3d_id GROUP BY 1, 2",
    "edges": "SELECT * FROM pairs WHERE weight >= 3",
    "links": "SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges",
    "nodes": "SELECT DISTINCT line3d_id AS id FROM direct",
    "reach": "SELECT id, id AS low FROM nodes UNION SELECT links.dst, reach.low FROM reach JOIN links ON reach.id = links.src WHERE reach.low < links.dst",
    "clusters": "SELECT min(low) AS cluster_id, id AS member_id FROM reach GROUP BY id",
    "seen": "SELECT l_orderkey AS point3d_id, l_suppkey AS cam_id, count(*) AS c FROM lineitem GROUP BY 1, 2",
    "overlap": "SELECT a.cam_id AS cam_a, b.cam_id AS cam_b, CAST(sum(CASE WHEN a.cam_id = b.cam_id THEN a.c * a.c + a.c ELSE a.c * b.c END) AS BIGINT) AS matches FROM seen a JOIN seen b USING (point3d_id) GROUP BY 1, 2",
    "near": "SELECT * FROM (SELECT cam_a AS cam_id, CAST(row_number() OVER (PARTITION BY cam_a ORDER BY matches DESC, cam_b) AS INTEGER) AS rank, cam_b AS neighbour_id, matches FROM overlap WHERE matches > 0) WHERE rank <= 10",
    "votes": "SELECT m.cam_id, m.mask_id, m.neighbour_id, count(DISTINCT t.mask_id) AS vote, min(t.mask_id) AS seen_mask FROM (SELECT DISTINCT f.cam_id, f.mask_id, n.neighbour_id FROM fine f JOIN near n ON f.cam_id = n.cam_id AND n.rank > 1) m LEFT JOIN (SELECT DISTINCT f.cam_id, f.mask_id, s.line3d_id FROM fine f JOIN s2l s USING (cam_id, seg_id)) o ON o.cam_id = m.cam_id AND o.mask_id = m.mask_id LEFT JOIN (SELECT l2s.cam_id, l2s.line3d_id, fine.mask_id FROM l2s JOIN fine USING (cam_id, seg_id)) t ON t.cam_id = m.neighbour_id AND t.line3d_id = o.line3d_id GROUP BY 1, 2, 3",
    "accepted": "SELECT cam_id, mask_id FROM votes GROUP BY 1, 2 HAVING max(vote) = 1",
    "one_way": "SELECT v.cam_id AS cam_a, v.mask_id AS mask_a, v.neighbour_id AS cam_b, v.seen_mask AS mask_b FROM votes v JOIN accepted USING (cam_id, mask_id) WHERE v.vote = 1",
    "medges": "SELECT DISTINCT * FROM (SELECT * FROM one_way UNION ALL SELECT cam_b, mask_b, cam_a, mask_a FROM one_way)",
    "emb": "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS e{i}" for i in range(1, 21)) + " FROM embeddings",
    "lines3d": "SELECT vec_id AS line3d_id, e1 * 10 AS x1, e2 * 10 AS y1, e3 * 10 AS z1, e4 * 10 AS x2, e5 * 10 AS y2, e6 * 10 AS z2 FROM emb",
    "q": "SELECT vec_id AS cam_id, CAST(label AS BIGINT) AS place, e7 / n AS w, e8 / n AS x, e9 / n AS y, e10 / n AS z, e11 AS p0, e12 AS p1, e13 AS p2 FROM (SELECT *, sqrt(e7 * e7 + e8 * e8 + e9 * e9 + e10 * e10) AS n FROM emb)",
    "rot": "SELECT cam_id, place, p0, p1, p2, 1 - 2 * (y * y + z * z) AS a00, 2 * (x * y - w * z) AS a01, 2 * (x * z + w * y) AS a02, 2 * (x * y + w * z) AS a10, 1 - 2 * (x * x + z * z) AS a11, 2 * (y * z - w * x) AS a12, 2 * (x * z - w * y) AS a20, 2 * (y * z + w * x) AS a21, 1 - 2 * (x * x + y * y) AS a22 FROM q",
    "cams": "SELECT cam_id, place, 100.0 AS width, 80.0 AS height, 60.0 AS f, a00 AS r00, a10 AS r01, a20 AS r02, a01 AS r10, a11 AS r11, a21 AS r12, a02 AS r20, a12 AS r21, a22 AS r22, -(a00 * p0 + a10 * p1 + a20 * p2) AS t0, -(a01 * p0 + a11 * p1 + a21 * p2) AS t1, -(a02 * p0 + a12 * p1 + a22 * p2) AS t2 FROM rot",
    "obs": "SELECT c.cam_id, e.e14 * 10 AS x, e.e15 * 10 AS y, e.e16 * 10 AS z FROM cams c JOIN emb e ON e.label = c.place",
    "segs": "SELECT CAST(label AS BIGINT) AS cam_id, vec_id AS seg_id, CAST(round_even(e14 * 96.0 + 24.0, 0) AS INTEGER) AS r0, CAST(round_even(e15 * 128.0 + 32.0, 0) AS INTEGER) AS c0, CAST(round_even(e16 * 96.0 + 24.0, 0) AS INTEGER) AS r1, CAST(round_even(e17 * 128.0 + 32.0, 0) AS INTEGER) AS c1 FROM emb",
    "steps": "SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS n, least(abs(r1 - r0), abs(c1 - c0)) AS m FROM segs",
    "walk": "SELECT *, CASE WHEN n = 0 THEN 0 ELSE (2 * m * i + n) // (2 * n) END AS k FROM (SELECT *, unnest(range(n + 1)) AS i FROM steps)",
    "pix": "SELECT * FROM (SELECT cam_id, seg_id, CAST(r0 + (CASE WHEN r1 > r0 THEN 1 ELSE -1 END) * (CASE WHEN abs(r1 - r0) > abs(c1 - c0) THEN i ELSE k END) AS INTEGER) AS row, CAST(c0 + (CASE WHEN c1 > c0 THEN 1 ELSE -1 END) * (CASE WHEN abs(r1 - r0) > abs(c1 - c0) THEN k ELSE i END) AS INTEGER) AS col FROM walk) WHERE row BETWEEN 0 AND 47 AND col BETWEEN 0 AND 63",
    "owner": "SELECT cam_id, row, col, max(seg_id) AS seg_id FROM pix GROUP BY 1, 2, 3",
    "rects": "SELECT CAST(label AS BIGINT) AS cam_id, vec_id AS mask_id, CAST(floor(abs(e18) * 960) AS BIGINT) % 40 AS top, CAST(floor(abs(e19) * 1280) AS BIGINT) % 56 AS left_, CAST(floor(abs(e20) * 640) AS BIGINT) % 6 + 2 AS size FROM emb",
    "runs": "SELECT cam_id, mask_id, top + unnest(range(size + 1)) AS row, left_ AS c0, left_ + size AS c1 FROM rects",
    "mpix": "SELECT cam_id, mask_id, row, c0 + unnest(range(c1 - c0 + 1)) AS col FROM runs",
    "area": "SELECT cam_id, mask_id, count(*) AS area FROM mpix GROUP BY 1, 2",
    "cover": "SELECT cam_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, mask_id FROM (SELECT cam_id, row, col, mask_id, row_number() OVER (PARTITION BY cam_id, row, col ORDER BY area DESC, mask_id) AS k FROM mpix JOIN area USING (cam_id, mask_id)) WHERE k = 1",
    "onmask": "SELECT p.cam_id, p.seg_id, coalesce(c.mask_id, -1) AS mask_id, count(*) AS n_px FROM owner p LEFT JOIN cover c ON c.cam_id = p.cam_id AND c.row = p.row AND c.col = p.col GROUP BY 1, 2, 3",
    "cand": "SELECT * FROM (SELECT *, r00 * x1 + r01 * y1 + r02 * z1 + t0 AS ax, r10 * x1 + r11 * y1 + r12 * z1 + t1 AS ay, r20 * x1 + r21 * y1 + r22 * z1 + t2 AS az, r00 * x2 + r01 * y2 + r02 * z2 + t0 AS bx, r10 * x2 + r11 * y2 + r12 * z2 + t1 AS by_, r20 * x2 + r21 * y2 + r22 * z2 + t2 AS bz, acos(least(1.0, greatest(-1.0, (((x1 + x2) / 2 - t0) * (x2 - x1) + ((y1 + y2) / 2 - t1) * (y2 - y1) + ((z1 + z2) / 2 - t2) * (z2 - z1)) / (sqrt(((x1 + x2) / 2 - t0) * ((x1 + x2) / 2 - t0) + ((y1 + y2) / 2 - t1) * ((y1 + y2) / 2 - t1) + ((z1 + z2) / 2 - t2) * ((z1 + z2) / 2 - t2)) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1)))))) AS turned FROM lines3d, cams) WHERE abs(turned - 1.5707963267948966) >= 0.5235987755982988 AND az > 0 AND bz > 0 AND f * ax / az >= 0 AND f * ax / az < width AND f * ay / az >= 0 AND f * ay / az < height AND f * bx / bz >= 0 AND f * bx / bz < width AND f * by_ / bz >= 0 AND f * by_ / bz < height",
    "smp": "SELECT *, r00 * sx + r01 * sy + r02 * sz + t0 AS ux, r10 * sx + r11 * sy + r12 * sz + t1 AS uy, r20 * sx + r21 * sy + r22 * sz + t2 AS uz FROM (SELECT *, x1 * s + x2 * (1 - s) AS sx, y1 * s + y2 * (1 - s) AS sy, z1 * s + z2 * (1 - s) AS sz FROM (SELECT *, unnest([0.1::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE, 0.9::DOUBLE]) AS s FROM cand))",
    "opt": "SELECT * FROM (SELECT o.cam_id, c.f, c.r00 * o.x + c.r01 * o.y + c.r02 * o.z + c.t0 AS px, c.r10 * o.x + c.r11 * o.y + c.r12 * o.z + c.t1 AS py, c.r20 * o.x + c.r21 * o.y + c.r22 * o.z + c.t2 AS pz FROM obs o JOIN cams c USING (cam_id)) WHERE pz > 0",
    "occ": "SELECT DISTINCT s.cam_id, s.line3d_id FROM smp s JOIN opt p ON p.cam_id = s.cam_id AND sqrt((s.f * s.ux / s.uz - p.f * p.px / p.pz) * (s.f * s.ux / s.uz - p.f * p.px / p.pz) + (s.f * s.uy / s.uz - p.f * p.py / p.pz) * (s.f * s.uy / s.uz - p.f * p.py / p.pz)) < 10 AND p.pz < 0.9 * s.uz",
    "dist": "SELECT src, dst, least("
    + ", ".join(
        f"(CASE WHEN {d2} = 0 THEN sqrt(({px} - {ax}) * ({px} - {ax}) + ({py} - {ay}) * ({py} - {ay})) ELSE sqrt(({px} - ({ax} + {t} * ({bx} - {ax}))) * ({px} - ({ax} + {t} * ({bx} - {ax}))) + ({py} - ({ay} + {t} * ({by} - {ay}))) * ({py} - ({ay} + {t} * ({by} - {ay})))) END)"
        for px, py, ax, ay, bx, by in (("ax1", "ay1", "bx1", "by1", "bx2", "by2"), ("ax2", "ay2", "bx1", "by1", "bx2", "by2"), ("bx1", "by1", "ax1", "ay1", "ax2", "ay2"), ("bx2", "by2", "ax1", "ay1", "ax2", "ay2"))
        for d2 in [f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"]
        for t in [f"greatest(0.0, least(1.0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {d2}))"]
    )
    + ") AS distance FROM (SELECT a.line3d_id AS src, b.line3d_id AS dst, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM lines3d a JOIN lines3d b ON a.line3d_id < b.line3d_id)",
    "planar": "SELECT * FROM dist WHERE distance <= 0.2",
    "planar2": "SELECT src, dst, distance FROM planar UNION ALL SELECT dst, src, distance FROM planar",
    "core": "SELECT src AS id, distance AS core FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS k FROM planar2) WHERE k = 3",
}


#: Pixels of a list of rasterised ends (r0, c0, r1, c1), for a relation and its key columns.
_PIXELS = "SELECT {keys}, r0 + (CASE WHEN r1 > r0 THEN 1 ELSE -1 END) * (CASE WHEN abs(r1 - r0) > abs(c1 - c0) THEN i ELSE k END) AS row, c0 + (CASE WHEN c1 > c0 THEN 1 ELSE -1 END) * (CASE WHEN abs(r1 - r0) > abs(c1 - c0) THEN k ELSE i END) AS col FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE (2 * m * i + n) // (2 * n) END AS k FROM (SELECT *, unnest(range(n + 1)) AS i FROM (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS n, least(abs(r1 - r0), abs(c1 - c0)) AS m FROM {source})))"
RELATIONS |= {
    "seen_lines": "SELECT cam_id, place, line3d_id, f * ay / az AS y1, f * ax / az AS x1, f * by_ / bz AS y2, f * bx / bz AS x2 FROM cand ANTI JOIN occ USING (cam_id, line3d_id)",
    "shown": "SELECT cam_id, place, line3d_id, " + ", ".join(f"CAST(round_even({c}, 0) AS INTEGER) AS {n}" for c, n in (("y1", "r0"), ("x1", "c0"), ("y2", "r1"), ("x2", "c1"))) + " FROM seen_lines",
    "shown_pix": _PIXELS.format(keys="cam_id, place, line3d_id", source="shown"),
    "projected": "SELECT cam_id, line3d_id, mask_id FROM (SELECT *, row_number() OVER (PARTITION BY cam_id, line3d_id ORDER BY n_px DESC, mask_id) AS k FROM (SELECT p.cam_id, p.line3d_id, coalesce(c.mask_id, -1) AS mask_id, count(*) AS n_px FROM shown_pix p LEFT JOIN cover c ON c.cam_id = p.place AND c.row = p.row AND c.col = p.col WHERE p.row BETWEEN 0 AND 47 AND p.col BETWEEN 0 AND 63 GROUP BY 1, 2, 3)) WHERE k = 1 AND mask_id <> -1",
    # labels of all masks, round by round: the lowest label around, and then that one's own label; 30 rounds are far more than are needed
    "mask_nodes": "SELECT (cam_a << 32) | mask_a AS src, (cam_b << 32) | mask_b AS dst FROM medges",
    "mask_label(turn, id, low)": "SELECT 0, src, src FROM (SELECT DISTINCT src FROM mask_nodes) UNION ALL SELECT n.turn + 1, n.id, least(n.around, j.low) FROM (SELECT r.turn, r.id, least(r.low, min(s.low)) AS around FROM mask_label r JOIN mask_nodes e ON e.src = r.id JOIN mask_label s ON s.id = e.dst GROUP BY r.turn, r.id, r.low) n JOIN mask_label j ON j.id = n.around WHERE n.turn < 30",
    "mask_part": "SELECT id, low FROM mask_label WHERE turn = 30",
    "near_lines": "SELECT src, dst FROM planar2 WHERE distance <= 0.05",
    "line_reach (id, low) USING KEY (id)": "SELECT DISTINCT src, src FROM near_lines UNION SELECT e.dst, min(r.low) FROM line_reach r JOIN near_lines e ON e.src = r.id JOIN recurring.line_reach s ON s.id = e.dst WHERE r.low < s.low GROUP BY e.dst",
}
RELATIONS |= {
    "seg_owner": "SELECT cam_id, seg_id, mask_id FROM (SELECT *, row_number() OVER (PARTITION BY cam_id, seg_id ORDER BY n_px DESC, mask_id) AS k FROM onmask WHERE mask_id <> -1) WHERE k = 1",
    # half-rounds of label propagation: nodes of one parity take the label of most weight around them, ties to the smallest
    "spread(turn, id, label)": "SELECT 0, id, id FROM nodes UNION ALL SELECT turn + 1, id, coalesce(won, label) FROM (SELECT s.turn, s.id, s.label, b.won FROM spread s LEFT JOIN "
    "(SELECT src, min_by(label, (-w, label)) AS won FROM (SELECT l.src, o.label, sum(l.weight) AS w, any_value(o.turn) AS turn FROM links l JOIN spread o ON o.id = l.dst GROUP BY 1, 2) WHERE src % 2 = turn % 2 GROUP BY 1) b ON b.src = s.id) WHERE turn < 40",
    # around each mask, one pixel wider than its box: the pixels that a walk from the corner reaches by sides without touching the mask
    "around_mask": "SELECT cam_id, mask_id, min(row) - 1 AS top, max(row) + 1 AS bottom, min(col) - 1 AS low, max(col) + 1 AS high FROM cover GROUP BY 1, 2",
    "free_pixels": "SELECT b.cam_id, b.mask_id, b.row, b.col, b.corner FROM (SELECT cam_id, mask_id, row, CAST(unnest(range(low, high + 1)) AS INTEGER) AS col, row = top AS corner FROM (SELECT *, CAST(unnest(range(top, bottom + 1)) AS INTEGER) AS row FROM around_mask)) b ANTI JOIN cover c ON c.cam_id = b.cam_id AND c.mask_id = b.mask_id AND c.row = b.row AND c.col = b.col",
    "outside_walk": "SELECT cam_id, mask_id, row, col FROM free_pixels WHERE corner UNION SELECT f.cam_id, f.mask_id, f.row, f.col FROM outside_walk w, (SELECT unnest([[0, 1], [1, 0], [0, -1], [-1, 0]]) AS d) JOIN free_pixels f ON f.cam_id = w.cam_id AND f.mask_id = w.mask_id AND f.row = w.row + d[1] AND f.col = w.col + d[2]",
    "edge_pixels": "SELECT DISTINCT c.cam_id, c.mask_id, c.row, c.col FROM cover c, (SELECT unnest([[0, 1], [1, 0], [0, -1], [-1, 0]]) AS d) JOIN outside_walk w ON w.cam_id = c.cam_id AND w.mask_id = c.mask_id AND w.row = c.row + d[1] AND w.col = c.col + d[2]",
}
#: Relations that are used more than once and are dear to work out.
KEPT = frozenset(("planar", "core", "cand", "occ", "votes", "direct", "fine", "s2l", "medges", "mask_nodes", "cover", "seg_owner", "free_pixels", "links"))


def sql(query: str, *needs: str) -> str:
    """A query with the relations it needs, in the order they are defined."""
    names = {re.match(r"\w+", full)[0]: full for full in RELATIONS}
    wanted = set(needs)
    for name in reversed(names):
        if name in wanted:
            wanted |= {n for n in names if n != name and re.search(rf"\b(FROM|JOIN|,) {n}\b", RELATIONS[names[name]])}
    parts = (f"{names[n]} AS {'MATERIALIZED ' * (n in KEPT)}({RELATIONS[names[n]]})" for n in names if n in wanted)
    return query if not wanted else "WITH RECURSIVE " + ", ".join(parts) + " " + query
