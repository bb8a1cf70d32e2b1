import struct
import zlib

import numpy as np
from strandloom.operators import overlay as K
from strandloom.sources import scene_files as S


def plain_edge(own):
    """Flood from the frame, pixel by pixel."""
    wide = np.pad(own, 1)
    todo, out = [(0, 0)], np.zeros(wide.shape, bool)
    while todo:
        y, x = todo.pop()
        if 0 <= y < len(wide) and 0 <= x < wide.shape[1] and not wide[y, x] and not out[y, x]:
            out[y, x] = True
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    near = np.zeros(wide.shape, bool)
    near[1:-1, 1:-1] = out[2:, 1:-1] | out[:-2, 1:-1] | out[1:-1, 2:] | out[1:-1, :-2]
    return (near & wide)[1:-1, 1:-1]


def test_outer_edge_matches_a_flood():
    rng = np.random.default_rng(5)
    ring = np.ones((9, 9), bool)
    ring[2:7, 2:7] = False
    ring[4, 4] = True  # an island in the hole has no outer edge
    for own in [ring, *(rng.random((12, 15)) < p for p in (0.3, 0.5, 0.6, 0.7, 0.8) for _ in range(20))]:
        r, c = np.nonzero(own)
        got = np.zeros(own.shape, bool)
        got[r, c] = K.outer_edge(r + 3, c + 7)
        assert np.array_equal(got, plain_edge(own))


def rgb_of(raw):
    at, data = 8, b""
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            assert (depth, colour) == (8, 2)
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + 3 * width)[:, 1:].reshape(height, width, 3)


def test_overlays(spark):
    pixels = spark.createDataFrame([(1, r, c, 9) for r in range(1, 6) for c in range(1, 6) if (r, c) != (3, 3)], "cam_id long, row int, col int, mask_id long")
    images = spark.createDataFrame([(1,), (2,)], "cam_id long")
    shown = K.mask_overlay(pixels, images, 8, 7)
    at = {(r.cam_id, r.row, r.col): (r.red, r.green, r.blue) for r in shown.collect()}
    assert len(at) == 2 * 8 * 7 and at[1, 1, 1] == (0, 0, 0) and at[1, 0, 0] == at[2, 5, 5] == at[1, 3, 3] == (216, 216, 216)
    assert at[1, 2, 3] == tuple(int(255 * (1 - 0.7) + v * 0.7) for v in (9 * 37 % 199 + 50, 9 * 53 % 193 + 50, 9 * 71 % 191 + 50))
    names = K.object_names(pixels, images)
    files = {r["name"]: rgb_of(bytes(r.png)) for r in S.write_overlays(shown, names).collect()}
    assert set(files) == {"1_1objs.png", "2_0objs.png"}
    assert all(tuple(files[f"{cam}_{2 - cam}objs.png"][r, c]) == v for (cam, r, c), v in at.items())

    segments = spark.createDataFrame([(1, 5, 0.0, 0.0, 0.0, 4.0), (1, 6, 0.0, 4.0, 3.0, 4.0), (1, 7, 7.0, 0.0, 7.0, 6.0)], "cam_id long, seg_id long, y1 double, x1 double, y2 double, x2 double")
    owner = spark.createDataFrame([(1, 5, 9), (1, 6, 8), (1, 7, -1)], "cam_id long, seg_id long, mask_id long")
    at = {(r.cam_id, r.row, r.col): (r.red, r.green, r.blue) for r in K.association_overlay(pixels, segments, owner, images, 8, 7).collect()}
    full = lambda i: (i * 37 % 149, i * 53 % 139, i * 71 % 131)
    assert len(at) == 2 * 8 * 7 and at[1, 0, 0] == at[1, 1, 2] == full(9) and at[1, 0, 4] == at[1, 3, 5] == full(8) and at[1, 7, 3] == (200, 200, 200)
    assert at[1, 4, 2] == tuple(round(140 + v * 0.3) for v in full(9))
    at = {(r.cam_id, r.row, r.col): (r.red, r.green, r.blue) for r in K.instance_colours(pixels, images, 8, 7).collect()}
    assert at[2, 0, 0] == (0, 0, 0) and min(at[1, 1, 1]) >= 50
