"""Pairs of lines and their common views, made and summed as packed columns."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Lines of a mask up to which its pairs are made here; pairs, and bytes of rows, that are worked on at once, about.
MASK_LINES, PAIRS, BYTES = 1_000, 1 << 21, 1 << 22


def _varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers as bytes of seven bits, the lowest first, and how many bytes each has."""
    size, rest = np.ones(len(v), np.int64), v >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest = rest >> np.uint64(7)
    at, out = np.cumsum(size) - size, np.empty(size.sum(), np.uint8)
    for k in range(size.max(initial=0)):
        has = size > k
        out[at[has] + k] = ((v[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[has] > k + 1) * np.uint8(128))
    return out, size


def _numbers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ``_varints``, and the places of their last bytes."""
    last = data < 128
    ends = np.flatnonzero(last)
    if not len(ends):
        return np.zeros(0, np.uint64), ends
    starts = np.r_[0, ends[:-1] + 1]
    shift = (np.arange(len(data)) - np.repeat(starts, ends - starts + 1)) * 7
    return np.add.reduceat((data & 127).astype(np.uint64) << shift.astype(np.uint64), starts), ends


def _signless(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).astype(np.uint64)


def _signed(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)


def _steps(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rising numbers as their steps; those at ``starts`` stay whole."""
    out = np.diff(v, prepend=0)
    out[starts] = v[starts]
    return _signless(out)


def _sums(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    steps = _signed(steps)
    total = np.cumsum(steps)
    before = (total - steps)[starts]
    return total - np.repeat(before, np.diff(np.r_[starts, len(steps)]))


def packed_lists(batches):
    """(line3d_id, views) with each sorted list of views as bytes."""
    for batch in batches:
        lists = batch.column("views")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        values = lists.flatten().to_numpy().astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        data, size = _varints(_steps(values, starts))
        ends = np.cumsum(size)[np.cumsum(sizes) - 1]
        offsets = np.r_[0, ends].astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("line3d_id"), pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])], ["line3d_id", "views"])


def _unpacked(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The views of all lists, and how many each has."""
    sizes = pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(blobs.to_pylist()), np.uint8)
    steps, ends = _numbers(data)
    upto = np.searchsorted(ends, np.cumsum(sizes) - 1) + 1
    counts = np.diff(np.r_[0, upto])
    return _sums(steps, upto - counts), counts


def _pairs(ends: np.ndarray, most: int):
    """Blocks (a, b) with a < b of all pairs in runs of rows; ``ends`` has the end of each row's run."""
    own = ends - np.arange(len(ends)) - 1
    upto = np.cumsum(own)
    low = 0
    while low < len(own):
        before = upto[low] - own[low]
        high = max(low + 1, int(np.searchsorted(upto, before + most, "right")))
        a = np.repeat(np.arange(low, high), own[low:high])
        yield low, high, a, a + 1 + np.arange(len(a)) - (upto[a] - own[a] - before)
        low = high


def _run_ends(*columns: np.ndarray) -> np.ndarray:
    """Of rows in order, the end of each one's run of equal values."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(np.r_[True, new[1:]])[: n or 0]
    ends = np.r_[starts[1:], n]
    return np.repeat(ends, ends - starts)


def _of_masks(cam: np.ndarray, mask: np.ndarray, line: np.ndarray, blobs: pa.Array):
    """(src, dst, common) of the pairs of lines of each of some masks, whose rows lie together."""
    group = np.cumsum(np.r_[0, (cam[1:] != cam[:-1]) | (mask[1:] != mask[:-1])])
    order = np.lexsort((line, group))
    group, cam, line = group[order], cam[order], line[order]
    views, counts = _unpacked(blobs.take(pa.array(order)))
    row = np.repeat(np.arange(len(line)), counts)
    other = views != cam[row]  # that view is common to all pairs of the mask
    row, views = row[other], views[other]
    order = np.lexsort((row, views, group[row]))
    row, views = row[order], views[order]
    ends, n = _run_ends(group[row], views), len(line)
    more = lambda: (row[x] * n + row[y] for _, _, x, y in _pairs(ends, PAIRS))
    few = int((ends - np.arange(len(ends)) - 1).sum()) <= 4 * PAIRS
    met = [np.concatenate([np.zeros(0, np.int64), *more()])] if few else None
    for low, high, a, b in _pairs(_run_ends(group), PAIRS):
        common, key = np.ones(len(a), np.int64), a * n + b  # in order
        for m in met or more():
            np.add.at(common, np.searchsorted(key, m[(m >= low * n) & (m < high * n)]), 1)
        kept = line[a] < line[b]
        yield line[a[kept]], line[b[kept]], common[kept]


def _blobs(src: np.ndarray, dst: np.ndarray, common: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, pack): the pairs of each bucket, equal ones summed, as bytes."""
    mixed = src.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ dst.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    bucket = ((mixed >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((dst, src, bucket))
    bucket, src, dst, common = bucket[order], src[order], dst[order], common[order]
    src, dst, weight, common, bucket = _summed(src, dst, np.ones(len(src), np.int64), common, bucket)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    packs = []
    for low, high in zip(cuts, np.r_[cuts[1:], len(bucket)]):
        columns = (_steps(src[low:high], np.zeros(1, int)), _signless(dst[low:high]), _signless(weight[low:high]), _signless(common[low:high]))
        packs.append(zlib.compress(b"".join(_varints(c)[0].tobytes() for c in columns), 1))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(packs, pa.binary())], ["bucket", "pack"])


def _summed(src, dst, weight, common, *more):
    """Of rows in order of (src, dst), one for each: weights summed, the largest common count."""
    if not len(src):
        return src, dst, weight, common, *more
    first = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
    return src[first], dst[first], np.add.reduceat(weight, first), np.maximum.reduceat(common, first), *(m[first] for m in more)


def _gathered(blocks, buckets: int):
    held, n = [], 0
    for block in blocks:
        held.append(block)
        n += len(block[0])
        if n >= PAIRS:
            yield _blobs(*(np.concatenate(c) for c in zip(*held)), buckets)
            held, n = [], 0
    if n:
        yield _blobs(*(np.concatenate(c) for c in zip(*held)), buckets)


def _masks(batches):
    """Tables of whole masks, of some ``BYTES``, from batches in order of (cam_id, mask_id)."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n < BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cam, mask = table["cam_id"].to_numpy(), table["mask_id"].to_numpy()
        before = np.flatnonzero((cam != cam[-1]) | (mask != mask[-1])) if len(cam) else []
        whole = int(before[-1]) + 1 if len(before) else 0
        yield table.slice(0, whole)
        held = table.slice(whole).combine_chunks().to_batches()
        n = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs_of_masks(buckets: int):
    """(bucket, pack) of all pairs of lines in a mask, from rows (cam_id, mask_id, line3d_id, views) in order of (cam_id, mask_id)."""

    def run(batches):
        blocks = (b for t in _masks(batches) if t.num_rows for b in _of_masks(*(t[c].to_numpy().astype(np.int64) for c in ("cam_id", "mask_id", "line3d_id")), t["views"].combine_chunks()))
        yield from _gathered(blocks, buckets)

    return run


def packed_pairs(buckets: int):
    """(bucket, pack) of rows (src, dst, common)."""

    def run(batches):
        yield from _gathered((tuple(b.column(c).to_numpy().astype(np.int64) for c in ("src", "dst", "common")) for b in batches), buckets)

    return run


def _sum_of(packs: list[bytes]):
    """(src, dst, weight, common) of the packs of one bucket."""
    found = []
    for pack in packs:
        values = _numbers(np.frombuffer(zlib.decompress(pack), np.uint8))[0].reshape(4, -1)
        found.append((_sums(values[0], np.zeros(1, int)), *(_signed(v) for v in values[1:])))
    columns = [np.concatenate(c) for c in zip(*found)]
    order = np.lexsort((columns[1], columns[0]))
    columns = _summed(*(c[order] for c in columns))
    for at in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], ["src", "dst", "weight", "common"])


def summed_pairs(batches):
    """(src, dst, weight, common) of rows (bucket, pack) in order of the bucket, a bucket at a time."""
    held, now = [], None
    for batch in batches:
        for bucket, pack in zip(batch.column("bucket").to_pylist(), batch.column("pack").to_pylist()):
            if held and bucket != now:
                yield from _sum_of(held)
                held = []
            held.append(pack)
            now = bucket
    if held:
        yield from _sum_of(held)


def summed(packs: DataFrame, buckets: int) -> DataFrame:
    """(src, dst, weight, common) of all packs (bucket, pack)."""
    return packs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(summed_pairs, "src long, dst long, weight long, common long")
