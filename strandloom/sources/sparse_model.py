"""Sparse photogrammetry models, binary and text.

Binary files are little-endian records behind a count and have no index: a pass
over the lengths cuts them into splits. They may lie in any file system that pyarrow
opens, and may be of any size. Text files are split by lines.
"""

from __future__ import annotations

import io
import shutil
import struct
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import base_name, pose
from .text_blocks import block_lines, with_totals_before

#: Fixed values of the public format: parameters of camera models 0 to 10, and their names.
MODEL_PARAMETERS = (3, 4, 4, 5, 8, 8, 12, 5, 4, 5, 12)
MODEL_NAMES = ("SIMPLE_PINHOLE", "PINHOLE", "SIMPLE_RADIAL", "RADIAL", "OPENCV", "OPENCV_FISHEYE", "FULL_OPENCV", "FOV", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE", "THIN_PRISM_FISHEYE")

INTRINSICS = "camera_id int, model string, width bigint, height bigint, params array<double>"
FEATURES = "array<struct<x: double, y: double, point3d_id: bigint>>"
IMAGES = f"image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, features {FEATURES}"
TRACK = "array<struct<image_id: int, point2d_idx: int>>"
POINTS = f"point3d_id bigint, xyz array<double>, rgb array<int>, error double, track {TRACK}"


#: The table that ends a record of a schema, and its entries.
TABLES = {IMAGES: ("features", np.dtype([("x", "<f8"), ("y", "<f8"), ("point3d_id", "<i8")])), POINTS: ("track", np.dtype([("image_id", "<i4"), ("point2d_idx", "<i4")]))}

#: Records and bytes that leave a reader at one time, at most (one record may be larger), and bytes of a split, about.
CHUNK_ROWS, CHUNK_BYTES, SPLIT_BYTES = 10_000, 8 << 20, 64 << 20


def _file_system(path: str):
    """The pyarrow file system of a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class _Cursor:
    """Reads a record's fields from a stream; one that skims passes over tables without decoding them."""

    def __init__(self, path: str, at: int = 0, skim: bool = False):
        system, name = _file_system(path)
        self.stream, self.skim = io.BufferedReader(system.open_input_file(name), 1 << 16 if skim else 1 << 20), skim
        self.stream.seek(at)

    def _bytes(self, size: int) -> bytes:
        out = self.stream.read(size)
        if len(out) < size:
            raise ValueError("the file ends within a record")
        return out

    def take(self, layout: str) -> tuple:
        return struct.unpack("<" + layout, self._bytes(struct.calcsize("<" + layout)))

    def table(self, schema: str) -> np.ndarray:
        """A count and as many equal records, as an array."""
        kind = TABLES[schema][1]
        size = self.take("Q")[0] * kind.itemsize
        if self.skim:
            self.stream.seek(size, io.SEEK_CUR)
            return np.zeros(0, kind)
        return np.frombuffer(self._bytes(size), kind)

    def name(self) -> str:
        out = bytearray()
        while (byte := self._bytes(1)) != b"\0":
            out += byte
        return out.decode()


def _intrinsic(c: _Cursor):
    camera, model, width, height = c.take("iiQQ")
    return camera, MODEL_NAMES[model], width, height, list(c.take(f"{MODEL_PARAMETERS[model]}d"))


def _image(c: _Cursor):
    image, *values, camera = c.take("i7di")
    return image, values[:4], values[4:], camera, c.name(), c.table(IMAGES)


def _point(c: _Cursor):
    point, x, y, z, r, g, b, error = c.take("QdddBBBd")
    return point, [x, y, z], [r, g, b], error, c.table(POINTS)


def _names(schema: str) -> list[str]:
    return {INTRINSICS: "camera_id model width height params", IMAGES: "image_id qvec tvec camera_id name features", POINTS: "point3d_id xyz rgb error track"}[schema].split()


def _decoded(records: list[tuple], schema: str, fields: pa.Schema) -> pa.RecordBatch:
    table, columns = TABLES.get(schema, (None,)), []
    for field, values in zip(fields, zip(*records)):
        if field.name == table[0]:
            entry, flat = field.type.value_type, np.concatenate(values)
            entries = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[n])) for n in table[1].names], fields=[entry.field(n) for n in table[1].names])
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), entries, type=field.type))
        else:
            columns.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(columns, schema=fields)


def _binary(spark: SparkSession, path: str, record, schema: str) -> DataFrame:
    """Records of all files of a path: one task a file passes over the lengths and cuts splits, and splits of any file are read by themselves."""
    split_bytes, chunk_bytes, fields = SPLIT_BYTES, CHUNK_BYTES, to_arrow_schema(T.StructType.fromDDL(schema))

    def cuts(batches):
        import pandas as pd

        for batch in batches:
            for file, length in zip(batch["path"], batch["length"].tolist()):
                cursor, out = _Cursor(file, skim=True), []
                begin, rows, left = 8, 0, cursor.take("Q")[0]
                while left:
                    record(cursor)
                    rows, left, at = rows + 1, left - 1, cursor.stream.tell()
                    if at - begin >= split_bytes or not left:
                        out.append((file, begin, rows))
                        begin, rows = at, 0
                if cursor.stream.tell() > length:
                    raise ValueError("the file ends within a record")
                if cursor.stream.tell() < length:
                    raise ValueError("bytes are left after the last record")
                yield pd.DataFrame(out, columns=["path", "begin", "rows"])

    def run(batches):
        for batch in batches:
            for split in batch.to_pylist():
                cursor, held, since = _Cursor(split["path"], split["begin"]), [], split["begin"]
                for left in reversed(range(split["rows"])):
                    held.append(record(cursor))
                    at = cursor.stream.tell()
                    if len(held) >= CHUNK_ROWS or at - since >= chunk_bytes or not left:
                        yield _decoded(held, schema, fields)
                        held, since = [], at

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # a listing: contents are not read
    parts = max(1, -(-(files.agg(F.sum("length")).first()[0] or 0) // split_bytes))
    return files.mapInPandas(cuts, "path string, begin long, rows long").repartition(parts).mapInArrow(run, schema)


def _head(schema: str, row: dict) -> bytes:
    if schema == INTRINSICS:
        model = MODEL_NAMES.index(row["model"])
        return struct.pack(f"<iiQQ{MODEL_PARAMETERS[model]}d", row["camera_id"], model, row["width"], row["height"], *row["params"])
    if schema == IMAGES:
        return struct.pack("<i7di", row["image_id"], *row["qvec"], *row["tvec"], row["camera_id"]) + row["name"].encode() + b"\0"
    return struct.pack("<QdddBBBd", row["point3d_id"], *row["xyz"], *row["rgb"], row["error"])


def _entries(table: pa.StructArray, kind: np.dtype) -> bytes:
    out = np.empty(len(table), kind)
    for name in kind.names:
        values = table.field(name)
        if table.null_count or values.null_count:
            raise ValueError(f"{name} of an entry is unknown")
        out[name] = values.to_numpy()
    return struct.pack("<Q", len(table)) + out.tobytes()


def _encoded(schema: str, batch: pa.RecordBatch):
    """The bytes of each record of a batch; entries of its table are arrays and never Python objects."""
    if schema not in TABLES:
        yield from (_head(schema, row) for row in batch.to_pylist())
        return
    name, kind = TABLES[schema]
    tables = batch.column(batch.schema.get_field_index(name))
    if tables.null_count:
        raise ValueError(f"{name} of a record is unknown")
    ends, entries = tables.offsets.to_numpy(), tables.values
    for i, row in enumerate(batch.drop_columns([name]).to_pylist()):
        yield _head(schema, row) + _entries(entries.slice(ends[i], ends[i + 1] - ends[i]), kind)


def write_binary(rows: DataFrame, folder: str, schema: str) -> None:
    """Rows of a schema as binary files, one for each partition; a task that runs again writes its own file anew.

    The count stands before the records, so a partition's records wait in a temporary file of the task.
    """

    def run(batches):
        from pyspark import TaskContext

        count = 0
        with tempfile.TemporaryFile() as body:
            for batch in batches:
                for record in _encoded(schema, batch):
                    body.write(record)
                count += batch.num_rows
            body.seek(0)
            system, name = _file_system(f"{folder}/part-{TaskContext.get().partitionId():06d}.bin")
            system.create_dir(name.rpartition("/")[0], recursive=True)
            with system.open_output_stream(name) as out:
                out.write(struct.pack("<Q", count))
                shutil.copyfileobj(body, out, 1 << 20)
        yield pa.RecordBatch.from_pydict({"count": pa.array([count], pa.int64())})

    rows.select(_names(schema)).mapInArrow(run, "count long").agg(F.sum("count")).collect()


def read_intrinsics(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, _intrinsic, INTRINSICS)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, _image, IMAGES)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, _point, POINTS)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def _numbers(values, kind: str):
    return F.transform(values, lambda v: v.cast(kind))


def _tuples(line: str, skipped: int, kind: str):
    """The words of a line after the first few as tuples of the array type ``kind``; an unfinished tuple is left out.

    The line is split once for all of its tuples: it may hold many thousands.
    """
    fields = [part.split(": ") for part in kind.removeprefix("array<struct<").removesuffix(">>").split(", ")]
    wide = len(fields)

    def made(words):
        count = F.floor((F.size(words) - skipped) / wide).cast("int")
        tuples = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.struct(*(F.get(words, skipped + wide * i + k).cast(t).alias(n) for k, (n, t) in enumerate(fields))))
        return F.when(count > 0, tuples).otherwise(F.array().cast(kind))

    return F.transform(F.array(F.split(F.col(line), r"\s+")), made)[0]


def read_intrinsics_text(spark: SparkSession, path: str) -> DataFrame:
    e = F.col("e")
    lines = _lines(spark, path).select(F.split("value", r"\s+").alias("e"))
    rest = F.when(F.size(e) > 4, F.slice(e, F.lit(5), F.size(e) - 4)).otherwise(F.array().cast("array<string>"))
    return lines.select(e[0].cast("int").alias("camera_id"), e[1].alias("model"), e[2].cast("bigint").alias("width"), e[3].cast("bigint").alias("height"), _numbers(rest, "double").alias("params"))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    e = F.col("e")
    lines = _lines(spark, path).select("value", F.split("value", r"\s+", 9).alias("e"))
    return lines.select(e[0].cast("bigint").alias("point3d_id"), _numbers(F.slice(e, 2, 3), "double").alias("xyz"), _numbers(F.slice(e, 5, 3), "int").alias("rgb"), e[7].cast("double").alias("error"), _tuples("value", 8, TRACK).alias("track"))


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """Two lines an image: the header, then its features (a line that may be empty)."""
    lines = with_totals_before(block_lines(spark, path, ~F.startswith("value", F.lit("#"))), F.lit(1), "file")
    lines = lines.select("file", (F.col("before") + F.col("at") - F.col("low")).alias("k"), F.trim("value").alias("line"))
    # headers and feature lines alternate from the first line that is not blank
    begin = lines.where("line <> ''").groupBy("file").agg(F.min("k").alias("begin"))
    pairs = lines.join(F.broadcast(begin), "file").where("k >= begin").withColumn("k", F.col("k") - F.col("begin"))  # a row a file
    line = lambda i: F.max(F.when(F.col("k") % 2 == i, F.col("line")))
    own = pairs.groupBy("file", F.floor(F.col("k") / 2).alias("pair")).agg(line(0).alias("head"), F.coalesce(line(1), F.lit("")).alias("next")).where("head <> ''")
    e = F.col("e")
    own = own.select(F.split("head", r"\s+").alias("e"), _tuples("next", 0, FEATURES).alias("features"))
    return own.select(e[0].cast("int").alias("image_id"), _numbers(F.slice(e, 2, 4), "double").alias("qvec"), _numbers(F.slice(e, 6, 3), "double").alias("tvec"), e[8].cast("int").alias("camera_id"), e[9].alias("name"), "features")


def cameras(images: DataFrame, intrinsics: DataFrame, scale: float = 1.0) -> DataFrame:
    """Posed cameras: size and focal lengths by scale (one focal length serves both axes), pose, name without suffix."""
    joined = images.join(intrinsics, "camera_id")
    r, t = pose(tuple(F.col("qvec")[i] for i in range(4)), tuple(F.col("tvec")[i] for i in range(3)), scale)
    fy = F.when(F.col("model") == "PINHOLE", F.col("params")[1]).otherwise(F.col("params")[0])
    return joined.select(
        F.col("image_id").alias("cam_id"), F.substring_index("name", ".", 1).alias("img_name"), base_name(F.col("name")).alias("base_name"), (F.col("width") / scale).alias("width"), (F.col("height") / scale).alias("height"),
        (F.col("params")[0] / scale).alias("fx"), (fy / scale).alias("fy"), *(r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), *(t[i].alias(f"t{i}") for i in range(3)),
    )


def features(images: DataFrame) -> DataFrame:
    """(cam_id, pos, point3d_id, x, y) of matched features."""
    return images.select(F.col("image_id").alias("cam_id"), F.posexplode("features").alias("pos", "f")).where("f.point3d_id <> -1").select("cam_id", "pos", F.col("f.point3d_id").alias("point3d_id"), F.col("f.x").alias("x"), F.col("f.y").alias("y"))


def tracks(points: DataFrame) -> DataFrame:
    return points.select("point3d_id", F.posexplode("track").alias("pos", "t")).select("point3d_id", "pos", F.col("t.image_id").alias("cam_id"))


def load(spark: SparkSession, folder: str, scale: float = 1.0) -> dict[str, DataFrame]:
    """cameras, features, tracks and points of a folder; text only where the binary files are absent, and ids counted from 0 if the first is 1."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = lambda name: hadoop(f"{folder}/{name}").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop(f"{folder}/{name}"))
    if all(there(f"{n}.bin") for n in ("cameras", "images", "points3D")):
        intrinsics, images, points = read_intrinsics(spark, f"{folder}/cameras.bin"), read_images(spark, f"{folder}/images.bin"), read_points(spark, f"{folder}/points3D.bin")
    else:
        intrinsics, images, points = read_intrinsics_text(spark, f"{folder}/cameras.txt"), read_images_text(spark, f"{folder}/images.txt"), read_points_text(spark, f"{folder}/points3D.txt")
    first = F.broadcast(images.agg((F.min("image_id") == 1).cast("int").alias("shift")))  # one row
    shifted = lambda df: df.crossJoin(first).withColumn("cam_id", F.col("cam_id") - F.coalesce("shift", F.lit(0))).drop("shift")
    xyz = points.select("point3d_id", *(F.col("xyz")[i].alias(c) for i, c in enumerate("xyz")))
    return {"cameras": shifted(cameras(images, intrinsics, scale)), "features": shifted(features(images)), "tracks": shifted(tracks(points)), "points": xyz}
