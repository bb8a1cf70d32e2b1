"""Helpers that the training-data operators share.

Text is handled per Arrow batch, cut into slices of a few megabytes, so the
memory of a task depends on the longest single text and never on the number of
rows in a batch or partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled, shared_dir, stored  # noqa: F401

#: ASCII white space, the separators of the word pattern ``[^\x20\x09-\x0D]+``.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one slice aims at.
SLICE_BYTES = 1 << 21


#: Rows in an Arrow batch; texts are long, so batches are short.
BATCH_ROWS = 1000
MOST_BROADCAST_ROWS = 1_000_000


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session has its own setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of the frame's own (Spark compares them without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in ``gone``; keys are broadcast only while they are few, which is counted first."""
    gone = settled(gone.select(key))
    return rows.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST_ROWS else gone, key, "left_anti")


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with about ``limit`` bytes; a longer text stands alone."""
    data, offsets = string_bytes(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def keyed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one key at a time, from batches that come sorted by whole-number keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in own])
        new[0] = bool(held) and any(x[0] != held[-1].column(k)[-1].as_py() for x, k in zip(own, keys))
        at = 0
        for edge in np.flatnonzero(new).tolist():
            if edge > at:
                held.append(batch.slice(at, edge - at))
            yield pa.Table.from_batches(held).combine_chunks()
            held, at = [], edge
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges as a binary array; they stand in order and do not overlap."""
    size = end - start
    full = size > 0
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start[full]] = 1
    edge[end[full]] -= 1
    kept = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of byte ranges, equal for equal bytes and for these alone: the bytes themselves are compared."""
    return range_array(data, start, end).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs of numbers, equal for equal pairs alone."""
    return pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0]


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit XXH3 of each byte range. Of n different ranges, two share both with a probability of n * n / 2**129."""
    raw, hashed = data.tobytes(), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([hashed(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())]), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def lowered_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end): the words with A-Z in lower case and one space between, so that a run of words is a range."""
    size = end - start
    to = np.cumsum(size + 1) - 1
    word = np.ones(int(to[-1]) + 1 if len(to) else 0, bool)
    word[to] = False
    out = np.full(len(word), 32, np.uint8)
    out[word] = LOWER[np.frombuffer(range_array(data, start, end).buffers()[2] or b"", np.uint8)]
    return out, to - size, to


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true bytes; a run ends where its text ends."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a value over each text's range."""
    sums = np.zeros(len(flags) + 1, np.float64 if flags.dtype.kind == "f" else np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
