"""Token-ID output: texts to ids, ids to range-coded blocks, and back.

Writing takes two passes. The first puts documents in doc_id order by ranges,
encodes them with the tokenizers library and gathers whole documents into blocks
of about ``BLOCK_IDS`` ids (a longer document is a block of its own). The second
codes every block with the one frequency table that all ids were counted into.
The archive is a Parquet folder: ``table`` (id, frequency count) and ``blocks``
(place, doc ids, lengths, coded payload), which any task can decode alone.

A text is encoded piecewise: byte-level BPE never joins across the start of a run
of white space, nor between a letter and a mark, so a text's ids are those of its
pieces in turn. A worker encodes each different piece once and keeps it; the cache
holds a bounded number of pieces, which only saves work. A text with white space
beyond ASCII is encoded whole.

Defined cases: null text counts as empty and has the end id alone; strings that
look like special tokens are ordinary text; null doc_ids come first; equal
doc_ids stand next to each other in text order; an empty table gives an archive
without blocks.
"""

from __future__ import annotations

import os
import uuid
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, SLICE_BYTES, mixed, shared_dir, short_batches, slices, stored, table
from .token_codec import FrequencyTable, decode, encode

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 1 << 19
CACHE_PIECES = 1_500_000
BLOCK_SCHEMA = "part int, block int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, ids binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Encodes pieces with the library's BPE model and keeps what it has seen.

    A piece is known by its own bytes, up to sixteen of them in two words; a longer
    piece has a number of its own there. Hashes of keys only say where to look; keys
    are compared, so no two pieces are ever taken for one.
    """

    def __init__(self, path: str, most: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.most = most
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.letters = _byte_letters()
        self.low, self.high = (np.zeros(1 << 16, np.uint64) for _ in range(2))
        self.starts, self.sizes, self.hits = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.flat = np.zeros(1 << 18, np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32)
        self.clear()

    def clear(self) -> None:
        self.known, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.n = self.used = self.numbers = 0
        self.long: dict[bytes, int] = {}

    def _parts(self, piece: bytes) -> list[str]:
        """The words that the library's pattern finds in a piece, in the byte-level alphabet."""
        lead, body = (self.letters[32], piece[1:]) if piece[:1] == b" " else ("", piece)
        if body.isalpha():
            return [lead + body.decode()]
        text = piece.decode()
        body = text[1:] if lead else text
        found = [text] if body.isalpha() and max(body) < "\u0530" else self.pattern.findall(text)
        return [p.encode().decode("latin-1").translate(self.letters) for p in found]

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in turn, number of ids of each)."""
        tokenize, parts = self.model.tokenize, self._parts
        ids = [[t.id for word in parts(p) for t in tokenize(word)] for p in pieces]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def forget(self) -> None:
        """Keep the half of the pieces that were asked for most."""
        if self.most < 2:
            return self.clear()
        stay = np.sort(np.argsort(-self.hits[: self.n], kind="stable")[: self.most // 2])
        sizes = self.sizes[stay].astype(np.int64)
        at = np.repeat(self.starts[stay] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        self.flat[: len(at)] = self.flat[at]
        m = len(stay)
        self.low[:m], self.high[:m], self.sizes[:m], self.hits[:m] = self.low[stay], self.high[stay], sizes, self.hits[stay] // 2
        self.starts[:m] = np.cumsum(sizes) - sizes
        numbers = set(self.low[:m][self.high[:m] == _LONG].tolist())
        self.long = {k: v for k, v in self.long.items() if v in numbers}
        self.n, self.used = m, len(at)
        hashes = _key_hash(self.low[:m], self.high[:m])
        order = np.argsort(hashes)
        self.known, self.entry = hashes[order], order.astype(np.int32)

    def add(self, hashes: np.ndarray, low: np.ndarray, high: np.ndarray, pieces: list[bytes]) -> None:
        flat, sizes = self.ids_of(pieces)
        end = self.n + len(pieces)
        while end > len(self.starts):
            self.low, self.high, self.starts, self.sizes, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.low, self.high, self.starts, self.sizes, self.hits))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        own = slice(self.n, end)
        self.low[own], self.high[own], self.sizes[own], self.hits[own] = low, high, sizes, 0
        self.starts[own] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(flat)] = flat
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, at, hashes[order])
        self.entry = np.insert(self.entry, at, np.arange(self.n, end, dtype=np.int32)[order])
        self.n, self.used = end, self.used + len(flat)

    def _key(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        lengths = end - start
        low, high = eight[start] & _KEEP[np.minimum(lengths, 8)], eight[start + 8] & _KEEP[np.clip(lengths - 8, 0, 8)]
        for i in np.flatnonzero(lengths > 16).tolist():
            low[i], high[i] = self.long.setdefault(data[start[i] : end[i]].tobytes(), self.numbers), _LONG
            self.numbers += 1
        return low, high

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of all texts in turn, number of ids of each text) for a slice; nothing if two different keys share a hash."""
        if self.n > self.most:
            self.forget()
        start = piece_starts(data, offsets)
        end = np.append(start[1:], len(data)) if len(start) else start
        low, high = self._key(data, start, end)
        code, hashes = pd.factorize(_key_hash(low, high))
        first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))  # codes count up as they appear
        own_low, own_high = low[first], high[first]
        if (own_low[code] != low).any() or (own_high[code] != high).any():
            return None
        order = np.argsort(hashes)
        at = np.empty(len(hashes), np.int64)
        at[order] = np.searchsorted(self.known, hashes[order])
        inside = at < len(self.known)
        new = ~inside
        new[inside] = self.known[at[inside]] != hashes[inside]
        entry = self.entry[at[~new]]
        if (self.low[entry] != own_low[~new]).any() or (self.high[entry] != own_high[~new]).any():
            return None
        if new.any():
            raw, where = data.tobytes(), first[new]
            self.add(hashes[new], own_low[new], own_high[new], [raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())])
            at[order] = np.searchsorted(self.known, hashes[order])
        entry = self.entry[at]
        self.hits[entry] += 1
        sizes = self.sizes[entry].astype(np.int64)[code]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[entry].astype(np.int64)[code] - (ends - sizes), sizes)
        ids = self.flat[shift + np.arange(len(shift))].astype(np.uint32)
        return ids, np.diff(np.append(0, ends)[np.searchsorted(start, offsets)])


#: Masks of the first 0 to 8 bytes of a little-endian word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: The second word of a long piece's key; no UTF-8 holds such bytes.
_LONG = np.uint64(2**64 - 1)
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[list(b'!"#$%&()*+,-./:;<=>?@[]\\^_`{|}~')] = True


def _key_hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mixed(mixed(low) ^ high)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text, at a run of white space, at a mark after a letter or a letter after a mark
    (apostrophes aside), and after a single tab or line break. The library's pattern ends a word at each of these, and
    what it finds on one side does not depend on the other."""
    space = IS_SPACE[data]
    head = np.zeros(len(data) + 1, bool)
    head[1:-1] = space[1:] & ~space[:-1]
    letter, mark = _LETTER[data], _MARK[data]
    head[1:-1] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    head[2:-1] |= ~space[:-2] & space[1:-1] & (data[1:-1] != 32) & ~space[2:]
    head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(head[: len(data)])


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold separators or white space beyond ASCII's six, or a zero byte."""
    b = np.concatenate([data, np.zeros(2, np.uint8)])
    x, y, z = b[:-2], b[1:-1], b[2:]
    odd = ((x >= 0x1C) & (x <= 0x1F)) | (x == 0)
    odd |= (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    odd |= ((x == 0xE1) & ((y == 0x9A) | (y == 0xA0))) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
    odd |= (x == 0xE2) & (((y == 0x80) & ((z <= 0x8B) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
    sums = np.concatenate([[0], np.cumsum(odd)])
    return sums[offsets[1:]] > sums[offsets[:-1]]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_slice(own: PieceEncoder, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id after each text, and the number of ids of each text."""
    odd = odd_texts(data, offsets)
    found = None if odd.any() else own.encode(data, offsets)
    if found is None:
        ids, sizes = [], []
        for i in range(len(offsets) - 1):
            text = data[offsets[i] : offsets[i + 1]]
            one = None if odd[i] else own.encode(text, np.array([0, len(text)]))
            one = one[0] if one else np.array(own.whole.encode(text.tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            ids.append(one)
            sizes.append(len(one))
        found = np.concatenate(ids), np.array(sizes, np.int64)
    ids, sizes = found
    return np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1


def _to_blocks(path: str, end_id: int, block_ids: int):
    def run(batches):
        own, part = encoder(path), TaskContext.get().partitionId()
        doc_ids, lengths, ids, held, block = [], [], [], 0, 0

        def row():
            flat = np.concatenate(ids)
            cells = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([flat.astype("<u4" if flat.max(initial=0) > 0xFFFF else "<u2").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, ["part", "block", "n_ids", "doc_ids", "lengths", "ids"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, _, data, offsets in slices(batch.column(1), 2 * SLICE_BYTES):
                flat, sizes = encode_slice(own, data, offsets, end_id)
                ends = np.cumsum(sizes)
                done = 0
                for i, (size, end) in enumerate(zip(sizes.tolist(), ends.tolist())):
                    if doc_ids and held + size > block_ids:
                        ids.append(flat[done : end - size])
                        yield row()
                        doc_ids, lengths, ids, held, block, done = [], [], [], 0, block + 1, end - size
                    doc_ids.append(names[lo + i])
                    lengths.append(size)
                    held += size
                ids.append(flat[done:])
        if doc_ids:
            yield row()

    return run


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = np.bincount(_ids(raw.as_py(), n))
            if len(counts) > len(total):
                total, counts = counts, total
            total[: len(counts)] += counts
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])


def written(docs: DataFrame, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, vocabulary: str | None = None) -> None:
    """Encode (doc_id, text) rows and write the archive below ``path``."""
    spark = docs.sparkSession
    short_batches(spark)
    vocabulary = vocabulary or vocabulary_path()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    blocks = stored(ordered.mapInArrow(_to_blocks(vocabulary, end_id, block_ids), BLOCK_SCHEMA), "token-blocks")
    counts = blocks.select("n_ids", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(frequency_table(spark, path))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("here"))
    parts = parts.withColumn("before", F.sum("here").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each task
    places = blocks.select("part", "block", "n_ids").join(parts, "part")
    earlier = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    places = places.select("part", "block", (F.coalesce("before", F.lit(0)) + F.coalesce(earlier, F.lit(0))).alias("start"))

    def coded(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                payload = encode(_ids(one.column(5)[0].as_py(), one.column(2)[0].as_py()), shared.value)
                yield pa.RecordBatch.from_arrays([*(one.column(k) for k in range(5)), pa.array([payload], pa.binary())], ["part", "block", "n_ids", "doc_ids", "lengths", "payload"])

    coded_blocks = blocks.mapInArrow(coded, BLOCK_SCHEMA.replace("ids binary", "payload binary"))
    coded_blocks.join(F.broadcast(places) if places.count() <= 100_000 else places, ["part", "block"]).write.option("compression", "none").parquet(f"{path}/blocks")


def frequency_table(spark: SparkSession, path: str) -> FrequencyTable:
    """The shared table; as many rows as the vocabulary at most."""
    rows = spark.read.parquet(f"{path}/table").toArrow()
    ids, n = (rows.column(i).to_numpy() for i in (0, 1))
    counts = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    counts[ids] = n
    return FrequencyTable(counts)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the archive."""
    shared = spark.sparkContext.broadcast(frequency_table(spark, path))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                names, sizes = batch.column(1)[i].values, batch.column(2)[i].values.to_numpy()
                ids = decode(batch.column(3)[i].as_py(), shared.value).astype("<u4")
                ends = np.cumsum(sizes)
                raw = memoryview(ids.tobytes())
                cells = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist())]
                out = [names, pa.array(batch.column(0)[i].as_py() + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(c) for c in cells], pa.int64())]
                if with_ids:
                    out.append(pa.array([np.frombuffer(c, "<u4").astype(np.int64) for c in cells], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids
    return spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "lengths", "payload").mapInArrow(run, schema)


def encoded(docs: DataFrame) -> DataFrame:
    """Write an archive of the documents in the shared folder and read it back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    written(docs, path)
    return read(spark, path)


def op5_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
