"""Line dedup through sharded minimal perfect hashes.

A line's key is the line stripped of ASCII white space, with A-Z in lower case.
Of a key with ``min_chars`` code points or more, all lines outside the smallest
doc_id that holds it are dropped.

Tasks hash each row's different lines to 128 bits; Spark reduces them to one row for each
different hash (smallest doc_id, number of rows). These rows are dealt to shards by
the first half of the hash, and each shard becomes one row of arrays: a minimal perfect hash
over the first halves, and at each index the second half as fingerprint, a count and the
owning doc_id. Lines that share a first half stand in a short list beside the arrays. Shards hold some
``SHARD_KEYS`` keys however large the corpus is. Documents do not join lines:
every task sends each shard packed probes of its lines (hash, document, number of the
line within the document), the shard's arrays answer which of them go, and the answers
meet the documents. A shard that a frequent line makes hot is copied and its probes
shared out among the copies.

Two of n different lines share a hash with a probability of n * n / 2**129; within a
document lines are compared by their bytes.

Defined cases: null and empty texts are one empty line; rows with equal doc_id
are one document; null doc_ids are one document that comes after all others; answers find
their rows by doc_id and a 64-bit hash of the text, so rows without a doc_id do not gather; columns
beside doc_id and text pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, LOWER, codes, digests, fresh, per_text, settled, slices, table
from .perfect_hash import PerfectHash

MIN_CHARS = 10
SHARD_KEYS = 250_000
SHARD_PROBES = 2_000_000
#: Lines that a task gathers before it sends the shards their probes.
SENT_LINES = 500_000
#: Stands for a null doc_id in packed arrays: after all others.
NO_ID = np.iinfo(np.int64).max
PROBE = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("sub", "<i8"), ("line", "<i4")])
TWIN = np.dtype([("h", "<u8"), ("g", "<u8"), ("count", "<u4"), ("owner", "<i8")])


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of every line; an empty text has one."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([offsets[1:], breaks]))
    owner = np.repeat(np.arange(len(offsets) - 1), per_text(data == 10, offsets) + 1)
    return owner, start, end


def line_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of the key, its end, whether it is long enough) of every line."""
    solid = np.flatnonzero(~IS_SPACE[data])
    if not len(solid):
        return start, start, np.zeros(len(start), bool)
    first, last = np.searchsorted(solid, start), np.searchsorted(solid, end)
    filled = last > first
    a = np.where(filled, solid[np.minimum(first, len(solid) - 1)], start)
    b = np.where(filled, solid[last - 1] + 1, start)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return a, b, filled & (chars[b] - chars[a] >= min_chars)


class Lines:
    """The lines of a slice's texts, with numbers that are equal for equal keys of one text alone."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_chars: int):
        self.owner, self.start, self.end = line_spans(data, offsets)
        self.lowered = LOWER[data]
        self.a, self.b, self.long_enough = line_keys(data, self.start, self.end, min_chars)
        self.count = np.bincount(self.owner, minlength=len(offsets) - 1)
        #: lines before each text
        self.before = np.cumsum(self.count) - self.count
        self.same = codes(self.lowered, self.a, self.b) * (len(offsets) - 1) + self.owner

    def different(self) -> np.ndarray:
        """The first line of each long enough key of each text."""
        at = np.flatnonzero(self.long_enough)
        return at[~pd.Series(self.same[at]).duplicated().to_numpy()]

    def dropped(self, first: np.ndarray) -> np.ndarray:
        """All lines with the keys of the given first lines."""
        return self.long_enough & np.isin(self.same, self.same[first])


def line_owners(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h, g, owner, n): each different line's hash, smallest doc_id and number of rows."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(batch.column(1)):
                lines = Lines(data, offsets, min_chars)
                at = lines.different()
                h, g = digests(lines.lowered, lines.a[at], lines.b[at])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(ids[lo:hi][lines.owner[at]])], ["h", "g", "doc"])

    lines = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "h long, g long, doc long")
    return lines.groupBy("h", "g").agg(F.min("doc").alias("owner"), F.count(F.lit(1)).alias("n"))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)


SHARD_SCHEMA = "shard int, hash binary, prints binary, counts binary, owners binary, twins binary"


def _build(rows: pa.Table) -> pa.Table:
    h, g = (rows.column(c).to_numpy().view(np.uint64) for c in ("h", "g"))
    owner, n = rows.column("owner").to_numpy(), np.minimum(rows.column("n").to_numpy(), 2**32 - 1)
    twin = pd.Series(h).duplicated().to_numpy()
    perfect = PerfectHash.of(h[~twin])
    at = perfect(h[~twin])
    size = len(h) - int(twin.sum())
    prints, counts, owners = np.empty(size, np.uint64), np.empty(size, np.uint32), np.empty(size, np.int64)
    prints[at], counts[at], owners[at] = g[~twin], n[~twin], owner[~twin]
    twins = np.zeros(int(twin.sum()), TWIN)
    twins["h"], twins["g"], twins["count"], twins["owner"] = h[twin], g[twin], n[twin], owner[twin]
    cells = [pa.array([rows.column("shard")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in (perfect.dump(), prints.tobytes(), counts.tobytes(), owners.tobytes(), twins.tobytes()))]
    return pa.table(cells, ["shard", "hash", "prints", "counts", "owners", "twins"])


def shards(owners: DataFrame) -> tuple[DataFrame, int]:
    """One row of arrays for each shard, and the number of shards."""
    number = max(1, -(-owners.count() // SHARD_KEYS))
    top = F.shiftrightunsigned("h", 32)
    dealt = owners.withColumn("shard", F.shiftrightunsigned(top * F.lit(number).cast("long"), 32).cast("int"))
    return dealt.groupBy("shard").applyInArrow(_build, SHARD_SCHEMA), number


class Arrays:
    """One shard's arrays, as a task uses them."""

    def __init__(self, hash_: bytes, prints: bytes, counts: bytes, owners: bytes, twins: bytes):
        self.perfect = PerfectHash.load(hash_)
        self.prints, self.counts, self.owners = np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32), np.frombuffer(owners, np.int64)
        self.twins = {(h, g): (n, owner) for h, g, n, owner in np.frombuffer(twins, TWIN).tolist()}

    def dropped(self, h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which lines another, smaller document holds."""
        at = self.perfect(h)
        known = (at >= 0) & (self.prints[at] == g)
        out = known & (self.counts[at] > 1) & (self.owners[at] != doc)
        if self.twins:
            for i in np.flatnonzero(~known).tolist():
                n, owner = self.twins.get((int(h[i]), int(g[i])), (0, 0))
                out[i] = n > 1 and owner != doc[i]
        return out


def _probes(number: int, min_chars: int):
    """One packed row for each shard and some hundred thousand lines."""

    def run(batches):
        task, sent, held, size = TaskContext.get().partitionId(), 0, [], 0

        def rows():
            probes = np.concatenate(held)
            shard = _shard(probes["h"], number)
            order = np.argsort(shard, kind="stable")
            probes, shard = probes[order], shard[order]
            starts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1]
            cells = [pa.array(shard[starts]), pa.array(np.full(len(starts), (task * 1_000_003 + sent) % 2**31, np.int64))]
            cells.append(pa.array([probes[a:b].tobytes() for a, b in zip(starts, np.r_[starts[1:], len(shard)])], pa.binary()))
            return pa.RecordBatch.from_arrays(cells, ["shard", "sender", "probes"])

        for batch in batches:
            ids, subs = (batch.column(i).fill_null(NO_ID).to_numpy(zero_copy_only=False) for i in (0, 1))
            for lo, hi, data, offsets in slices(batch.column(2)):
                lines = Lines(data, offsets, min_chars)
                at = lines.different()
                probes = np.zeros(len(at), PROBE)
                probes["h"], probes["g"] = digests(lines.lowered, lines.a[at], lines.b[at])
                text = lines.owner[at]
                probes["doc"], probes["sub"], probes["line"] = ids[lo:hi][text], subs[lo:hi][text], at - lines.before[text]
                held.append(probes)
                size += len(at)
                if size >= SENT_LINES:
                    yield rows()
                    held, size, sent = [], 0, sent + 1
        if size:
            yield rows()

    return run


def _answer(batches):
    """Rows come by shard, its arrays first."""
    arrays, current = None, None
    for batch in batches:
        columns = [batch.column(c) for c in ("shard", "copy", "hash", "prints", "counts", "owners", "twins", "probes")]
        out = []
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in columns]
            if row[2] is not None:
                arrays, current = Arrays(*row[2:7]), row[:2]
            else:
                if current != row[:2]:
                    raise RuntimeError("probes without their shard")
                probes = np.frombuffer(row[7], PROBE)
                out.append(probes[arrays.dropped(probes["h"], probes["g"], probes["doc"])])
        if out:
            gone = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(gone[c])) for c in ("doc", "sub", "line")], ["doc", "sub", "line"])


def _sub() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, sub, line): the first line of each key that a document loses; sub is its text's hash."""
    owners = settled(line_owners(docs, min_chars))
    arrays, number = shards(owners)
    probes = docs.select(F.col("doc_id").cast("long"), _sub(), "text").mapInArrow(_probes(number, min_chars), "shard int, sender long, probes binary")
    top = F.shiftrightunsigned("h", 32)
    loads = owners.groupBy(F.shiftrightunsigned(top * F.lit(number).cast("long"), 32).cast("int").alias("shard")).agg(F.ceil(F.sum("n") / SHARD_PROBES).cast("int").alias("copies"))
    loads = settled(loads)
    empty = F.lit(None).cast("binary")
    names = ["hash", "prints", "counts", "owners", "twins"]
    have = arrays.join(loads, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    have = have.select("shard", "copy", *names, empty.alias("probes"))
    ask = probes.join(loads, "shard").select("shard", F.pmod("sender", "copies").cast("int").alias("copy"), *(empty.alias(c) for c in names), "probes")
    both = have.unionByName(ask).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("hash").isNull())
    return both.mapInArrow(_answer, "doc long, sub long, line int")


def deduplicated(docs: DataFrame, keep: list[str], min_chars: int = MIN_CHARS, with_text: bool = True) -> DataFrame:
    """The columns ``keep`` with n_lines, n_dropped, kept_sha256 and, if asked for, the lines that stay as ``kept_text``."""
    key, sub, gone = fresh(docs, "doc_key", "doc_sub", "gone")
    per_doc = dropped_lines(docs, min_chars).groupBy("doc", "sub").agg(F.collect_set("line").alias("gone"))  # as long as one text's lines
    per_doc = per_doc.select(F.col("doc").alias(key), F.col("sub").alias(sub), F.col("gone").alias(gone))
    source = docs.select(*dict.fromkeys([*keep, "doc_id", "text"]), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias(key), _sub().alias(sub))
    rows = source.join(per_doc, [key, sub], "left")
    names = rows.columns
    text_at, gone_at, kept = names.index("text"), names.index(gone), [names.index(c) for c in keep]
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    added += [T.StructField("kept_text", T.StringType())] * with_text

    def run(batches):
        for batch in batches:
            n_lines, n_dropped, shas, texts = [], [], [], []
            lists = batch.column(gone_at)
            for lo, hi, data, offsets in slices(batch.column(text_at)):
                lines = Lines(data, offsets, min_chars)
                lost = lists.slice(lo, hi - lo)
                sizes = lost.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                first = np.repeat(lines.before, sizes) + lost.flatten().to_numpy(zero_copy_only=False)
                drop = lines.dropped(first)
                lost_lines = np.bincount(lines.owner[drop], minlength=hi - lo)
                raw = data.tobytes()
                for i in range(hi - lo):
                    body = raw[offsets[i] : offsets[i + 1]]
                    if lost_lines[i]:
                        at = lines.before[i]
                        own = np.flatnonzero(~drop[at : at + lines.count[i]]) + at
                        body = b"\n".join(raw[a:b] for a, b in zip(lines.start[own].tolist(), lines.end[own].tolist()))
                    shas.append(hashlib.sha256(body).hexdigest())
                    if with_text:
                        texts.append(body.decode())
                n_lines.append(lines.count)
                n_dropped.append(lost_lines)
            cells = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (n_lines, n_dropped)] + [pa.array(shas, pa.string())]
            cells += [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *cells], [*keep, *(f.name for f in added)])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *added]))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], with_text=False)


OP6_SQL = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM parts
), k AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
  SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM o GROUP BY doc_id
"""
