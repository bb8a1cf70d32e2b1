"""Static range asymmetric numeral coding of token ids.

A block is coded on its own: its ids go to ``lanes`` interleaved coders, id i to
lane ``i % lanes``, all with one shared frequency table. Each lane's state stays in
[2**31, 2**63) and sheds 32-bit words. Layout of a block, little-endian:

    "RNS1", u32 ids, u32 lanes, u32 probability bits, u32 words, u32 checkpoints,
    u32 crc32 of the ids as u32, u32 crc32 of all that follows the header,
    checkpoints x (u32 step, u32 word), checkpoints x lanes x u64 states, words x u32

A checkpoint holds what a decoder needs to start at its step, so the parts of a
block between checkpoints decode independently. The first stands at step 0.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PROBABILITY_BITS = 18
MOST_LANES = 2048
CHECKPOINT_STEPS = 128
LOW = np.uint64(1 << 31)
HEADER = struct.Struct("<4s7I")


class FrequencyTable:
    """Counts scaled to ``2**bits``; every id that was counted keeps at least 1."""

    def __init__(self, counts: np.ndarray, bits: int = PROBABILITY_BITS):
        counts = np.asarray(counts, np.int64)
        total, whole = int(counts.sum()), 1 << bits
        if np.count_nonzero(counts) > whole:
            raise ValueError("more different ids than the table has room for")
        freq = np.zeros(len(counts), np.int64)
        if total:
            freq = np.where(counts > 0, np.maximum(1, (counts * (whole / total)).astype(np.int64)), 0)
            gap = whole - int(freq.sum())
            if gap > 0:
                freq[np.argmax(freq)] += gap
            for i in np.argsort(-freq, kind="stable"):
                if gap >= 0:
                    break
                cut = min(-gap, int(freq[i]) - 1)
                freq[i] -= cut
                gap += cut
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else np.zeros(0, np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)


def lanes_for(n: int) -> int:
    lanes = 1
    while lanes < MOST_LANES and lanes * 512 <= n:
        lanes *= 2
    return lanes


def encode(ids: np.ndarray, table: FrequencyTable) -> bytes:
    n = len(ids)
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    grid = np.full(steps * lanes, int(np.argmax(table.freq)) if len(table.freq) else 0, np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    state = np.full(lanes, LOW, np.uint64)
    bits, shed = np.uint64(table.bits), np.uint64(63 - table.bits)
    chunks, states, marks, written = [], [], [], 0
    for step in range(steps - 1, -1, -1):
        row = grid[step]
        freq = table.freq[row]
        full = state >= (freq << shed)
        out = state[full]
        chunks.append(out.astype(np.uint32))
        written += len(out)
        state[full] = out >> np.uint64(32)
        quotient = state // freq
        state = (quotient << bits) + (state - quotient * freq) + table.cum[row]
        if step % CHECKPOINT_STEPS == 0:
            states.append(state.copy())
            marks.append((step, written))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    head = [(step, written - w) for step, w in marks[::-1]]
    body = np.array(head, "<u4").tobytes() + b"".join(s.astype("<u8").tobytes() for s in states[::-1]) + words.astype("<u4").tobytes()
    ids_crc = zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
    return HEADER.pack(b"RNS1", n, lanes, table.bits, written, len(head), ids_crc, zlib.crc32(body)) + body


def _parts(payload: bytes):
    magic, n, lanes, bits, words, marks, ids_crc, body_crc = HEADER.unpack_from(payload)
    if magic != b"RNS1" or zlib.crc32(memoryview(payload)[HEADER.size :]) != body_crc:
        raise ValueError("a token block is damaged")
    at = HEADER.size
    heads = np.frombuffer(payload, "<u4", 2 * marks, at).reshape(-1, 2)
    at += 8 * marks
    states = np.frombuffer(payload, "<u8", marks * lanes, at).reshape(marks, lanes)
    at += 8 * marks * lanes
    return n, lanes, bits, heads, states, np.frombuffer(payload, "<u4", words, at), ids_crc


def decode_part(parts, table: FrequencyTable, k: int) -> np.ndarray:
    """The ids from checkpoint k to the next."""
    n, lanes, bits, heads, states, words, _ = parts
    steps = -(-n // lanes)
    first, at = (int(x) for x in heads[k])
    last = int(heads[k + 1][0]) if k + 1 < len(heads) else steps
    state = states[k].astype(np.uint64)
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    out = np.empty((last - first, lanes), np.uint32)
    for step in range(last - first):
        slot = state & mask
        symbol = table.symbol[slot]
        out[step] = symbol
        state = table.freq[symbol] * (state >> shift) + slot - table.cum[symbol]
        short = np.flatnonzero(state < LOW)
        state[short] = (state[short] << np.uint64(32)) | words[at : at + len(short)]
        at += len(short)
    return out.ravel()[: n - first * lanes]


def decode(payload: bytes, table: FrequencyTable) -> np.ndarray:
    """All ids of a block; raises if it or its ids do not match their checksums."""
    parts = _parts(payload)
    if parts[2] != table.bits:
        raise ValueError("the block was coded with another table")
    out = [decode_part(parts, table, k) for k in range(len(parts[3]))]
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != parts[6]:
        raise ValueError("a token block does not decode to its ids")
    return ids
