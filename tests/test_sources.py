import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.sources import scene_files as S
from strandloom.sources import sparse_model as M


def model_files(folder):
    h = 0.5**0.5
    (folder / "cameras.bin").write_bytes(struct.pack("<Q", 2) + struct.pack("<iiQQ4d", 1, 1, 640, 480, 500, 510, 320, 240) + struct.pack("<iiQQ3d", 2, 0, 100, 80, 90, 50, 40))
    image = lambda i, cam, name, feats: struct.pack("<i7di", i, h, 0, 0, h, 1, 2, 3, cam) + name.encode() + b"\0" + struct.pack("<Q", len(feats)) + b"".join(struct.pack("<ddq", *f) for f in feats)
    (folder / "images.bin").write_bytes(struct.pack("<Q", 2) + image(1, 1, "a/one.x.jpg", [(1.5, 2.5, 7), (3, 4, -1)]) + image(2, 2, "two.png", []))
    (folder / "points3D.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<QdddBBBd", 7, 1, 2, 3, 255, 0, 9, 0.5) + struct.pack("<Q", 2) + struct.pack("<iiii", 1, 0, 2, 1))
    (folder / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 510 320 240\n2 SIMPLE_PINHOLE 100 80 90 50 40\n")
    (folder / "images.txt").write_text(f"# i\n1 {h!r} 0 0 {h!r} 1 2 3 1 a/one.x.jpg\n1.5 2.5 7 3 4 -1\n2 {h!r} 0 0 {h!r} 1 2 3 2 two.png\n\n")
    (folder / "points3D.txt").write_text("# p\n7 1 2 3 255 0 9 0.5 1 0 2 1\n")


def test_binary_and_text_models_agree(spark, tmp_path):
    model_files(tmp_path)
    for a, b in ((M.read_intrinsics, M.read_intrinsics_text), (M.read_images, M.read_images_text), (M.read_points, M.read_points_text)):
        name = {"read_intrinsics": "cameras", "read_images": "images", "read_points": "points3D"}[a.__name__]
        one, two = a(spark, f"file://{tmp_path}/{name}.bin"), b(spark, f"file://{tmp_path}/{name}.txt")
        assert sorted(one.collect(), key=repr) == sorted(two.collect(), key=repr)
    scene = M.load(spark, f"file://{tmp_path}")
    cams = {r.cam_id: r for r in scene["cameras"].collect()}
    assert set(cams) == {0, 1} and cams[0].base_name == "one" and cams[1].fy == cams[1].fx == 90
    c = cams[0]
    assert np.allclose([[c[f"r{i}{j}"] for j in range(3)] for i in range(3)], [[0, 1, 0], [-1, 0, 0], [0, 0, 1]]) and np.allclose([c.t0, c.t1, c.t2], [-2, 1, -3])
    assert [tuple(r) for r in scene["features"].select("cam_id", "point3d_id", "x", "y").collect()] == [(0, 7, 1.5, 2.5)]
    assert sorted(r.cam_id for r in scene["tracks"].collect()) == [0, 1]
    (tmp_path / "cut.bin").write_bytes((tmp_path / "images.bin").read_bytes() + b"x")
    with pytest.raises(Exception, match="bytes are left"):
        M.read_images(spark, f"file://{tmp_path}/cut.bin").collect()


def test_segments_and_lines(spark, tmp_path):
    (tmp_path / "segments_L3D++_3_10x8.bin").write_text("<?xml version='1.0'?><r><d><item><x>1</x><y>2</y><z>30</z><w>-4</w></item><item><x>0</x><y>9</y><z>1</z><w>1</w></item></d></r>")
    rows = sorted(map(tuple, S.read_segments(spark, f"file://{tmp_path}").collect()))
    assert rows == [(3, 0, 2.0, 1.0, 0.0, 9.0), (3, 1, 7.0, 0.0, 1.0, 1.0)]
    (tmp_path / "Line3D++x.txt").write_text("2 0 0 0 1 0 0 0 1 0 1 1 0 1 5 7 0 0 1 1\n1 9 9 9 8 8 8 0\n")
    lines, residuals = S.read_lines3d(spark, f"file://{tmp_path}/Line3D++x.txt")
    assert sorted(tuple(r)[:4] for r in lines.collect()) == [(0, 0, 0, 0), (1, 0, 1, 0), (2, 9, 9, 9)]
    assert sorted((r.line3d_id, r.cam_id, r.seg_id) for r in residuals.collect()) == [(0, 5, 7), (1, 5, 7)]


def test_splits_change_no_id(spark, tmp_path):
    rows = [f"{1 + i % 2} " + "1 2 3 4 5 6 " * (1 + i % 2) + f"1 {i} 7 0 0 1 1" for i in range(300)]
    (tmp_path / "lines.txt").write_text("\n".join(rows) + "\n\n")
    images = [f"{i} 1 0 0 0 0 0 0 1 n{i}.png\n" + " ".join(f"{j} {i} {j}" for j in range(i % 4)) for i in range(300)]
    (tmp_path / "images.txt").write_text("# a\n\n# b\n" + "\n".join(images[:150]) + "\n# c\n" + "\n".join(images[150:]))
    got = []
    for size in ("128m", "200"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines, residuals = S.read_lines3d(spark, f"file://{tmp_path}/lines.txt")
            pictures = M.read_images_text(spark, f"file://{tmp_path}/images.txt")
            assert (spark.read.text(f"file://{tmp_path}/lines.txt").rdd.getNumPartitions() > 40) == (size == "200")
            got.append([sorted(map(tuple, df.collect())) for df in (lines, residuals, pictures.select("image_id", "name", "features"))])
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0] == got[1]
    lines, residuals, pictures = got[0]
    assert [r[0] for r in lines] == list(range(450)) and [(r[0], r[2]) for r in residuals] == [(k, i) for k, i in enumerate(i for i in range(300) for _ in range(1 + i % 2))]
    assert [(i, name, len(f)) for i, name, f in pictures] == [(i, f"n{i}.png", i % 4) for i in range(300)]


def test_binary_splits_change_no_row(spark, tmp_path, monkeypatch):
    images = [(i, [1.0, 0.0, 0.0, 0.0], [0.5, 1.0, 2.0], 1, f"n{i}.png", [(float(j), float(i), j) for j in range(i % 5)]) for i in range(200)]
    points = [(i, [1.0, 2.0, 3.0], [1, 2, 255], 0.5, [(i, j) for j in range(i % 3)]) for i in range(300)]
    for rows, schema, read in ((images, M.IMAGES, M.read_images), (points, M.POINTS, M.read_points)):
        folder = f"file://{tmp_path}/{read.__name__}"
        M.write_binary(spark.createDataFrame(rows, schema).repartition(2), folder, schema)
        got = []
        for size in (1 << 26, 300):
            monkeypatch.setattr(M, "SPLIT_BYTES", size)
            df = read(spark, folder)
            assert (df.rdd.getNumPartitions() > 20) == (size == 300)
            got.append(sorted(df.collect()))
        assert got[0] == got[1] == sorted(spark.createDataFrame(rows, schema).collect())
    whole = next((tmp_path / "read_points").glob("*.bin")).read_bytes()
    (tmp_path / "short.bin").write_bytes(whole[:-5])
    with pytest.raises(Exception, match="ends within a record"):
        M.read_points(spark, f"file://{tmp_path}/short.bin").collect()


def filtered_png(values, kind):
    """A 16-bit PNG whose lines use one filter."""
    own = np.asarray(values).astype(">u2").view(np.uint8).reshape(len(values), -1).astype(int)
    lines = b""
    for y, line in enumerate(own):
        up = own[y - 1] if y else np.zeros_like(line)
        left, corner = np.r_[[0, 0], line[:-2]], np.r_[[0, 0], up[:-2]]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        lines += bytes([kind]) + ((line - [0 * line, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
    part = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", own.shape[1] // 2, len(own), 16, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def test_png_filters():
    image = np.random.default_rng(1).integers(0, 65536, (7, 9))
    for kind in range(5):
        assert np.array_equal(S.png_gray(filtered_png(image, kind)), image)
    assert np.array_equal(S.png_gray(S.gray_png(image % 256, 8)), image % 256)


def test_masks_round_trip(spark, tmp_path):
    runs = [("v", 4, 0, 1, 3), ("v", 300, 1, 0, 0)]
    sizes = spark.createDataFrame([("v", 5, 3), ("empty", 2, 2)], "img_name string, width int, height int")
    for r in S.write_merged_masks(spark.createDataFrame(runs, S.RUNS), sizes).collect():
        (tmp_path / f"{r.img_name}_seg_uint16.png").write_bytes(bytes(r.png))
    assert sorted(map(tuple, S.read_merged_masks(spark, f"file://{tmp_path}").collect())) == runs
    np.save(tmp_path / "v.npy", np.array([[-1, 4, 4], [300, -1, -1]], np.int16))
    assert sorted(map(tuple, S.read_mask_arrays(spark, f"file://{tmp_path}").collect())) == [("v", 4, 0, 1, 2), ("v", 300, 1, 0, 0)]
    (tmp_path / "arrays").mkdir()
    for r in S.write_mask_arrays(spark.createDataFrame(runs, S.RUNS), sizes).collect():
        (tmp_path / "arrays" / f"{r.img_name}.npy").write_bytes(bytes(r.npy))
    assert sorted(map(tuple, S.read_mask_arrays(spark, f"file://{tmp_path}/arrays").collect())) == runs
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "12.png").write_bytes(S.gray_png([[0, 1, 2], [255, 0, 0]], 8))
    assert sorted(map(tuple, S.read_single_masks(spark, f"file://{tmp_path}").collect())) == [("img", 12, 0, 2, 2), ("img", 12, 1, 0, 0)]
    assert sorted(map(tuple, S.read_black_patches(spark, f"file://{tmp_path}/img").collect())) == [("12.png", 0, 0, 2), ("12.png", 1, 1, 2)]
    (tmp_path / "d.bin").write_bytes(b"2&1&1&" + np.array([1, 2], "<f4").tobytes())
    dense = S.read_dense(spark, f"file://{tmp_path}/d.bin").first()
    assert (dense.width, dense.height, dense.data) == (2, 1, [1.0, 2.0])


def test_stage_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert S.stage(spark, f"file://{tmp_path}/s", make).count() == 3
    assert made == [1]
    clusters = spark.createDataFrame([(1, 5)], "cluster_id long, member_id long")
    lines = spark.createDataFrame([(5, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "line3d_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    assert len(S.cluster_ply(clusters, lines).first().value.split()) == 9


def test_coercion(spark):
    from strandloom.functions.values import coerced, leaves

    df = spark.createDataFrame([("1",), ("1.5",), ("x",), (" 2 ",), (None,)], "v string").select(*(c.alias(n) for c, n in zip(coerced(F.col("v")), ("whole", "number", "text"))))
    assert [tuple(r) for r in df.collect()] == [(1, None, None), (None, 1.5, None), (None, None, "x"), (2, None, None), (None, None, None)]
    nested = [(1, '{"1": {"x": ["2", "2.5", "b", {"": "03"}]}, "t": true, "n": null, "e": [], "f": 1.25, "i": 7}'), (2, '"9"'), (3, "no json"), (4, None), (5, '"' + "9" * 30 + '"')]
    got = sorted(map(tuple, leaves(spark.createDataFrame(nested, "k long, j string"), "k", "j").collect()), key=str)
    want = [(1, "$.1.x[0]", 2, None, None, None), (1, "$.1.x[1]", None, 2.5, None, None), (1, "$.1.x[2]", None, None, "b", None), (1, "$.1.x[3].", 3, None, None, None), (1, "$.f", None, 1.25, None, None)]
    want += [(1, "$.i", 7, None, None, None), (1, "$.n", None, None, None, None), (1, "$.t", None, None, None, True), (2, "$", 9, None, None, None), (5, "$", None, None, None, None)]
    assert got == sorted(want, key=str)


def test_arriving_masks_are_merged_once(spark, tmp_path):
    from strandloom.streaming.incremental import merge_arriving_runs

    schema = "cam_id long, mask_id long, row int, c0 int, c1 int"
    for cam in (0, 1):
        spark.createDataFrame([(cam, 5, 0, 0, 5), (cam, 6, 0, 4, 7)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        merge_arriving_runs(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    out = sorted((r.cam_id, r.c0, r.c1, r.mask_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert out == [(0, 0, 7, 5), (1, 0, 7, 5)]


def test_late_masks_redo_their_image_alone(spark, tmp_path):
    from strandloom.operators.raster import merged_masks
    from strandloom.streaming.incremental import latest, merge_arriving_runs

    schema = "cam_id long, mask_id long, row int, c0 int, c1 int"
    runs = [(cam, mask, row, 3 * mask, 3 * mask + 4 + cam) for cam in range(3) for mask in range(4) for row in range(2)]
    want = sorted(map(tuple, merged_masks(spark.createDataFrame(runs, schema)).collect()))
    for name, arrivals in (("a", [runs[:5], runs[5:12] + runs[:2], runs[12:]]), ("b", [runs[::-1][:9], runs[::-1][9:]])):
        for part in arrivals:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            merge_arriving_runs(spark, f"{tmp_path}/{name}/in", schema, f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/state").awaitTermination()
        got = latest(spark, f"{tmp_path}/{name}/out")
        assert sorted(map(tuple, got.select("cam_id", *[c for c in merged_masks(spark.createDataFrame(runs, schema)).columns if c != "cam_id"]).collect())) == want
    # the third arrival of the first order holds images 1 and 2 only
    assert {r.cam_id for r in spark.read.parquet(f"{tmp_path}/a/out/batch=2").collect()} == {1, 2}


def test_tables_of_binary_records_are_never_python_objects(spark, tmp_path, monkeypatch):
    import tracemalloc

    entries = [(i + 0.5, 2.0 * i, i % 7 - 1) for i in range(20_000)]
    rows = [(k, [1.0, 0.0, 0.0, 0.0], [0.5, 0.25, 2.0], 1, f"view{k}.png", entries[: 20_000 * (k % 3) // 2]) for k in range(9)]
    folder = f"file://{tmp_path}/images"
    M.write_binary(spark.createDataFrame(rows, M.IMAGES).coalesce(1), folder, M.IMAGES)
    monkeypatch.setattr(M, "CHUNK_BYTES", 300_000)  # less than one image: chunks end by bytes
    back = M.read_images(spark, folder).orderBy("image_id").collect()
    assert [(r.image_id, r.name, [tuple(f) for f in r.features]) for r in back] == [(r[0], r[4], r[5]) for r in rows]
    cursor = M._Cursor(next(f"{p}" for p in (tmp_path / "images").iterdir() if p.stat().st_size > 1_000_000), 8)
    tracemalloc.start()
    records = [M._image(cursor) for _ in range(9)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(r[-1]) for r in records) == 90_000 and peak < 3 * 24 * 90_000 + (2 << 20)


def test_an_unknown_entry_is_not_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0], 1, "a", [(1.0, 2.0, None)])], M.IMAGES)
    with pytest.raises(Exception, match="unknown"):
        M.write_binary(rows, f"file://{tmp_path}/none", M.IMAGES)
