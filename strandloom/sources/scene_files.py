"""Segment, 3D-line, mask and depth files; PNG, run-length, PLY and stage output."""

from __future__ import annotations

import io
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import clipped, colour
from .text_blocks import KEY, block_lines, with_totals_before


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """(cam_id, seg_id, y1, x1, y2, x2) of XML files named ``segments_L3D++_<id>_<w>x<h>.bin``, clipped to the image."""
    files = spark.read.format("binaryFile").load(f"{folder}/segments_*.bin")
    part = lambda i: F.regexp_extract("path", r"_(\d+)_(\d+)x(\d+)\.bin$", i).cast("int")
    rows = files.select(part(1).alias("cam_id"), part(2).alias("w"), part(3).alias("h"), *(F.expr(f"xpath(cast(content as string), '//item/{c}/text()')").alias(f"i{c}") for c in "xyzw"))
    rows = rows.select("cam_id", "w", "h", F.posexplode(F.arrays_zip("ix", "iy", "iz", "iw")).alias("seg_id", "i"))
    row = lambda c: clipped(F.col(f"i.{c}").cast("float"), F.lit(0.0), F.col("h") - 1).cast("float")
    col = lambda c: clipped(F.col(f"i.{c}").cast("float"), F.lit(0.0), F.col("w") - 1).cast("float")
    return rows.select("cam_id", "seg_id", row("iy").alias("y1"), col("ix").alias("x1"), row("iw").alias("y2"), col("iz").alias("x2"))


def read_lines3d(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, residuals) of a text file of rows ``n (6 numbers) x n m (cam seg 4 numbers) x m``; the lines of a row share its residuals.

    Ids run over the rows of the file (of files in order of their names), whatever the splits.
    """
    rows = block_lines(spark, path, F.trim("value") != "").withColumn("e", F.split(F.trim("value"), r"\s+")).drop("value").withColumn("n", F.col("e")[0].cast("int"))
    rows = with_totals_before(rows, F.col("n")).withColumn("m", F.get("e", 1 + 6 * F.col("n")).cast("int"))
    # a window holds the lines of one split
    rows = rows.withColumn("first", F.col("before") + F.sum("n").over(Window.partitionBy(*KEY).orderBy("at")) - F.col("n"))
    number = lambda i: F.get("e", i).cast("double")
    counted = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    lines = rows.withColumn("j", F.explode(counted(F.col("n"))))
    line_id = (F.col("first") + F.col("j")).alias("line3d_id")
    residuals = lines.withColumn("i", F.explode(counted(F.col("m"))))
    at = 2 + 6 * F.col("n") + 6 * F.col("i")
    return (
        lines.select(line_id, *(number(1 + 6 * F.col("j") + k).alias(c) for k, c in enumerate(("x1", "y1", "z1", "x2", "y2", "z2")))),
        residuals.select(line_id, F.col("i").alias("proj_pos"), number(at).cast("int").alias("cam_id"), number(at + 1).cast("int").alias("seg_id"), *(number(at + 2 + k).alias(c) for k, c in enumerate(("p1x", "p1y", "q1x", "q1y")))),
    )


def png_gray(raw: bytes):
    """The values of an 8- or 16-bit gray PNG without interlacing."""
    import numpy as np

    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
    width, height, depth, colour_type, _, _, interlace = head
    if colour_type or interlace or depth not in (8, 16):
        raise ValueError("only 8- and 16-bit gray images without interlacing are read")
    size = depth // 8
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * size)
    out, before = np.zeros((height, width * size), np.uint8), np.zeros(width * size, np.uint8)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 1:  # each byte adds to the one a pixel before it, modulo 256
            line = np.cumsum(line.reshape(width, size), 0, dtype=np.uint8).ravel()
        elif kind == 2:
            line = line + before
        elif kind:
            own, up = line.astype(int).tolist(), before.astype(int).tolist()
            for i in range(len(own)):
                a, c = (own[i - size], up[i - size]) if i >= size else (0, 0)
                if kind == 3:
                    guess = (a + up[i]) // 2
                else:
                    guess = min((a, up[i], c), key=lambda v: abs(a + up[i] - c - v))
                own[i] = (own[i] + guess) & 255
            line = np.array(own, np.uint8)
        out[y] = before = line
    return out.view(">u2").astype(int) if size == 2 else out.astype(int)


def _png(lines, width: int, depth: int, colour_type: int) -> bytes:
    import numpy as np

    lines = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], 1)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, len(lines), depth, colour_type, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def gray_png(values, depth: int = 16) -> bytes:
    import numpy as np

    own = np.asarray(values).astype(">u2" if depth == 16 else np.uint8)
    return _png(own.view(np.uint8).reshape(own.shape[0], -1), own.shape[1], depth, 0)


def rgb_png(values) -> bytes:
    """An 8-bit colour PNG of an array of height, width and three channels."""
    import numpy as np

    own = np.ascontiguousarray(values, np.uint8)
    return _png(own.reshape(own.shape[0], -1), own.shape[1], 8, 2)


def runs_of(image, keep) -> list[tuple[int, int, int, int]]:
    """(row, c0, c1, value) of the runs whose value ``keep`` accepts."""
    import numpy as np

    out = []
    for r, line in enumerate(image):
        cut = np.flatnonzero(np.diff(line)) + 1
        out += [(r, int(a), int(b) - 1, int(line[a])) for a, b in zip(np.r_[0, cut], np.r_[cut, len(line)]) if keep(line[a])]
    return out


def _mask_files(spark: SparkSession, glob: str, decode, schema: str) -> DataFrame:
    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                yield pd.DataFrame(decode(path, bytes(content)), columns=[c.split()[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInPandas(run, schema)


RUNS = "img_name string, mask_id int, row int, c0 int, c1 int"


def read_single_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of ``<image>/<mask_id>.png``; foreground is above 1."""

    def decode(path, raw):
        image, name = path.split("/")[-2], path.split("/")[-1]
        on = (png_gray(raw) > 1).astype(int)
        return [(image, int(name.split(".")[0]), r, a, b) for r, a, b, _ in runs_of(on, lambda v: v == 1)]

    return _mask_files(spark, f"{folder}/*/*.png", decode, RUNS)


def read_merged_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of ``<image>_seg_uint16.png`` (value: mask id + 1, 0 background)."""

    def decode(path, raw):
        image = path.split("/")[-1].removesuffix("_seg_uint16.png")
        return [(image, v - 1, r, a, b) for r, a, b, v in runs_of(png_gray(raw), lambda v: v > 0)]

    return _mask_files(spark, f"{folder}/*_seg_uint16.png", decode, RUNS)


def read_mask_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of ``<image>.npy`` (mask id, -1 background)."""

    def decode(path, raw):
        import numpy as np

        image = path.split("/")[-1].removesuffix(".npy")
        return [(image, v, r, a, b) for r, a, b, v in runs_of(np.load(io.BytesIO(raw), allow_pickle=False), lambda v: v >= 0)]

    return _mask_files(spark, f"{folder}/*.npy", decode, RUNS)


def read_black_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Runs (file, row, c0, c1) of the black pixels (127 or less) of 8-bit masks."""
    return _mask_files(spark, f"{folder}/*.png", lambda path, raw: [(path.split("/")[-1], r, a, b) for r, a, b, _ in runs_of((png_gray(raw) <= 127).astype(int), lambda v: v == 1)], "file string, row int, c0 int, c1 int")


def read_labels(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """(line3d_id, label) of a saved array of labels in order of line ids, or of a Parquet folder with these columns; -1 is noise.

    With ``lines``, a label for a line that is not there, or a line without label, is an error.
    """

    def decode(_, raw):
        import numpy as np

        return enumerate(np.load(io.BytesIO(raw), allow_pickle=False).astype(int).tolist())

    labels = _mask_files(spark, path, decode, "line3d_id long, label long") if path.endswith(".npy") else spark.read.parquet(path).select("line3d_id", "label")
    if lines is not None:
        odd = labels.join(lines.select(F.col("line3d_id"), F.lit(True).alias("known")), "line3d_id", "full").where("known is null or label is null")
        if not odd.isEmpty():
            raise ValueError("labels and lines do not belong together")
    return labels


def read_dense(spark: SparkSession, glob: str) -> DataFrame:
    """(path, width, height, channels, data) of depth and normal maps: ``w&h&c&`` and column-major float32; data is row-major."""

    def decode(path, raw):
        import numpy as np

        w, h, c, rest = raw.split(b"&", 3)
        w, h, c = int(w), int(h), int(c)
        values = np.frombuffer(rest, "<f4").reshape((w, h, c), order="F").transpose(1, 0, 2)
        return [(path, w, h, c, values.ravel().tolist())]

    return _mask_files(spark, glob, decode, "path string, width int, height int, channels int, data array<float>")


def write_merged_masks(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img_name, png): 16-bit images of (img_name, mask_id, row, c0, c1) runs; sizes has (img_name, width, height)."""
    import pandas as pd

    def paint(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        image = np.zeros((int(rows.height.iloc[0]), int(rows.width.iloc[0])), np.uint16)
        for r in rows.dropna(subset=["mask_id"]).itertuples():
            image[int(r.row), int(r.c0) : int(r.c1) + 1] = int(r.mask_id) + 1
        return pd.DataFrame({"img_name": [rows.img_name.iloc[0]], "png": [gray_png(image)]})

    return sizes.join(runs, "img_name", "left").groupBy("img_name").applyInPandas(paint, "img_name string, png binary")


def write_overlays(pixels: DataFrame, names: DataFrame) -> DataFrame:
    """(name, png): colour images of (cam_id, row, col, red, green, blue); names has (cam_id, name). A group is one image."""
    import pandas as pd

    def paint(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        image = np.zeros((int(rows.row.max()) + 1, int(rows.col.max()) + 1, 3), np.uint8)
        image[rows.row, rows.col] = rows[["red", "green", "blue"]]
        return pd.DataFrame({"name": [rows["name"].iloc[0]], "png": [rgb_png(image)]})

    return pixels.join(names.select("cam_id", F.col("name").alias("file")), "cam_id").groupBy("file").applyInPandas(lambda rows: paint(rows.rename(columns={"file": "name"})), "name string, png binary")


def write_mask_arrays(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img_name, npy): int16 arrays of (img_name, mask_id, row, c0, c1) runs, background -1; sizes has (img_name, width, height)."""
    import pandas as pd

    def paint(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        image = np.full((int(rows.height.iloc[0]), int(rows.width.iloc[0])), -1, np.int16)
        for r in rows.dropna(subset=["mask_id"]).itertuples():
            image[int(r.row), int(r.c0) : int(r.c1) + 1] = int(r.mask_id)
        out = io.BytesIO()
        np.save(out, image, allow_pickle=False)
        return pd.DataFrame({"img_name": [rows.img_name.iloc[0]], "npy": [out.getvalue()]})

    return sizes.join(runs, "img_name", "left").groupBy("img_name").applyInPandas(paint, "img_name string, npy binary")


def cluster_ply(clusters: DataFrame, lines: DataFrame) -> DataFrame:
    """(cluster_id, line3d_id, value): a PLY edge line, with a colour for each cluster."""
    rows = clusters.join(lines, clusters["member_id"] == lines["line3d_id"])
    r, g, b = colour(F.col("cluster_id"))
    return rows.select("cluster_id", "line3d_id", F.concat_ws(" ", "x1", "y1", "z1", "x2", "y2", "z2", r, g, b).alias("value"))


def stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The stage at ``path`` if it was completed, else what ``make()`` gives, written there first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
