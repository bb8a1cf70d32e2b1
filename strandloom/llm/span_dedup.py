"""Substring dedup over sliding spans of sentences.

A text is cut into sentences: one starts at a text's first word, on a new line,
after a word that ends in ``.``, ``!`` or ``?``, and at a capitalised word after a
word that is not capitalised (text that was pasted in without a full stop). A
passage may start or end inside a sentence, so sentences are cut into clauses after
``,``, ``;`` and ``:``, and a clause of more than ``LONG`` words is cut before every
word whose hash is the smallest of those up to ``REACH`` words away: the words around
a cut decide it, wherever the passage stands. What is still longer than ``MOST`` words
(words that recur with a short period) is cut every ``LONG`` words. Sentence means
such a piece in what follows and in n_sentences and n_removed. From
every sentence, and back from every sentence's end, the shortest run of at least
``SENTENCES`` sentences and ``MIN_WORDS`` words is hashed (case and white
space do not count). Of equal runs the one in the smallest doc_id, and there the
first, stays; every sentence that another of them covers is removed.

Runs meet by hash in shards, ``SHARDS`` for each shuffle partition and more where the texts, counted first, are
longer than ``SHARD_BYTES`` a shard; every task sends each shard packed columns.
Before that, each task settles its own repeats:
of equal runs in a chunk only the first can be first overall, so the others are
marked on the spot and a passage that a third of all documents hold meets once for each
chunk, not once for each document. Runs are compared by 96 bits of a hash: two of n
different ones share theirs with a probability of n * n / 2**97.

Defined cases: null and empty texts have no sentences and come back as they are;
rows with equal doc_id and equal text are copies of one document and lose the same
sentences; other texts of that doc_id are documents of their own, ordered by a hash of 31 bits;
each row with a null doc_id is a document of its own, after all others (doc_ids are below 2**63 - 2**60); other columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, digests, fresh, lowered_words, range_array, short_batches, slices, spans, stored, table
from .line_dedup import NO_ID

SENTENCES = 2
MIN_WORDS = 20
LONG = 14
REACH = 3
MOST = 20
#: Runs that a task compares among themselves before they are sent.
CHUNK_RUNS = 1_000_000
#: Shards for each shuffle partition at least, and bytes of text for each shard at most: a shard is one group in a task.
SHARDS = 4
SHARD_BYTES = 64 << 20
#: Columns of packed runs: hash, more of it, document, text, first sentence, number of sentences (with SETTLED on top).
RUN = [("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("sub", "<u4"), ("a", "<u4"), ("size", "<u2")]
SETTLED = 1 << 15
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".!?,;:")] = True


def _cuts(head: np.ndarray, owner: np.ndarray, word: np.ndarray) -> np.ndarray:
    """``head`` with the starts of the pieces of long clauses added."""
    n = len(head)

    def length(head):
        first = np.flatnonzero(head)
        return first, np.diff(np.append(first, n))

    first, words = length(head)
    if not (words > LONG).any():
        return head
    least = np.zeros(n, bool)
    if n > 2 * REACH:
        least[REACH : n - REACH] = owner[: n - 2 * REACH] == owner[2 * REACH :]
        inner = word[REACH : n - REACH]
        for d in range(1, REACH + 1):
            least[REACH : n - REACH] &= (inner < word[REACH - d : n - REACH - d]) & (inner <= word[REACH + d : n - REACH + d])
    head = head | (least & np.repeat(words > LONG, words))
    first, words = length(head)
    since = np.arange(n) - np.repeat(first, words)
    return head | (np.repeat(words > MOST, words) & (since % LONG == 0))


class Sentences:
    """Words and sentences of a slice's texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end = spans(~IS_SPACE[data], offsets)
        self.lowered = lowered_words(data, self.start, self.end)
        n = len(self.start)
        self.owner = np.searchsorted(offsets, self.start, "right") - 1
        head = np.ones(n, bool)
        if n > 1:
            second = data[np.minimum(self.start + 1, len(data) - 1)]
            lead = data[self.start]
            capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
            lines = np.concatenate([[0], np.cumsum(data == 10)])[self.start]
            head[1:] = (self.owner[1:] != self.owner[:-1]) | (lines[1:] != lines[:-1]) | _CLOSING[data[self.end[:-1] - 1]] | (capital[1:] & ~capital[:-1])
            head = _cuts(head, self.owner, self._word_values())
        # index of each sentence's first word, then the number of words
        self.first = np.append(np.flatnonzero(head), n)
        self.text = self.owner[self.first[:-1]]
        # sentences before each text
        self.bounds = np.searchsorted(self.text, np.arange(len(offsets)))

    def _word_values(self) -> np.ndarray:
        """A hash of each word, which decides cuts only."""
        words = range_array(*self.lowered).dictionary_encode()
        values = np.fromiter((xxhash.xxh3_64_intdigest(x.as_buffer()) for x in words.dictionary), np.uint64, len(words.dictionary))
        return values[words.indices.to_numpy(zero_copy_only=False)]

    def runs(self, sentences: int, min_words: int) -> tuple[np.ndarray, ...]:
        """(hash, second hash, text, first sentence, end sentence) of each run, sentences numbered within the text."""
        m = len(self.text)
        if not m:
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none.view(np.uint64), none, none, none
        low, high = self.bounds[self.text], self.bounds[self.text + 1]
        here = np.arange(m)
        until = np.maximum(here + sentences, np.searchsorted(self.first, self.first[:-1] + min_words))
        since = np.minimum(here + 1 - sentences, np.searchsorted(self.first, self.first[1:] - min_words, "right") - 1)
        forward, back = until <= high, since >= low
        a = np.concatenate([here[forward], since[back]])
        b = np.concatenate([until[forward], here[back] + 1])
        pair = pd.Series(a * (m + 1) + b)
        once = ~pair.duplicated().to_numpy()
        a, b = a[once], b[once]
        data, start, end = self.lowered
        text = self.text[a]
        return *digests(data, start[self.first[a]], end[self.first[b] - 1]), text, a - self.bounds[text], b - self.bounds[text]


def _repeats_within(h, g, doc, sub, a):
    """Whether an equal run of the chunk comes before: a smaller document, or an earlier place in the same one."""
    order = np.lexsort((a, sub, doc, g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    out = np.empty(len(h), bool)
    out[order] = (doc[order] != doc[first]) | (sub[order] != sub[first]) | (a[order] != a[first])
    return out


def _pack(columns: list[np.ndarray]) -> bytes:
    return zstandard.compress(len(columns[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).astype(t).tobytes() for c, (_, t) in zip(columns, RUN)), 1)


def _unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(packed)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _, kind in RUN:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _spans(sentences: int, min_words: int, shards: int):
    def run(batches):
        held, size = [], 0

        def rows():
            h, g, doc, sub, a, b = (np.concatenate(x) for x in zip(*held))
            # a run that is known to repeat needs to meet nobody, but comes along
            again = _repeats_within(h, g, doc, sub, a)
            columns = [h, g & np.uint64(0xFFFFFFFF), doc, sub, a, (b - a) | again * SETTLED]
            shard = (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            ends = np.flatnonzero(np.diff(shard[order], append=-1)) + 1
            for lo in range(0, len(ends), 64):
                some = list(zip([0, *ends[:-1]][lo : lo + 64], ends[lo : lo + 64]))
                packed = [_pack([c[order[x:y]] for c in columns]) for x, y in some]
                yield pa.RecordBatch.from_arrays([pa.array(shard[order[[x for x, _ in some]]]), pa.array(packed, pa.binary())], ["shard", "packed"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            subs = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in slices(batch.column(2)):
                h, g, text, a, b = Sentences(data, offsets).runs(sentences, min_words)
                held.append((h, g, ids[lo + text], subs[lo + text], a, b))
                size += len(h)
                if size >= CHUNK_RUNS:
                    yield from rows()
                    held, size = [], 0
        if size:
            yield from rows()

    return run


def _meet(rows: pa.Table) -> pa.Table:
    """One shard's runs that repeat one that comes before."""
    h, g, doc, sub, a, size = (np.concatenate(x) for x in zip(*(_unpack(x.as_py()) for x in rows.column("packed"))))
    again = size >= SETTLED
    live = np.flatnonzero(~again)
    live = live[np.argsort(h[live], kind="stable")]
    near = h[live][1:] == h[live][:-1]
    several = live[np.r_[near, False] | np.r_[False, near]]
    again[several] = _repeats_within(h[several], g[several], doc[several], sub[several], a[several])
    first = a[again].astype(np.int64)
    place = first << 32 | (first + (size[again] & np.uint16(SETTLED - 1)))
    return pa.table([pa.array(doc[again]), pa.array(sub[again].astype(np.int64)), pa.array(place)], ["doc", "sub", "place"])


def numbered(docs: DataFrame, keep: list[str], key: str, sub: str) -> DataFrame:
    """The columns ``keep`` and text, with a number for each doc_id and 31 bits of the text's hash; rows without a doc_id count up from 2**63 - 2**60.

    Only those rows are written to a table, so each has the same number whenever they are read.
    """
    rows = docs.select(*dict.fromkeys([*keep, "doc_id", "text"])).withColumn(key, F.col("doc_id").cast("long"))
    unnamed = stored(rows.where(F.col(key).isNull()).withColumn(key, F.lit(int(NO_ID) - (1 << 60)) + F.monotonically_increasing_id()), "span-dedup")
    return rows.where(F.col(key).isNotNull()).unionByName(unnamed).withColumn(sub, F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)))


def repeated_spans(rows: DataFrame, key: str, sub: str, sentences: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, sub, place): sentence ranges, first and end in one number, that repeat a run that comes before."""
    if max(sentences, min_words) >= SETTLED:
        raise ValueError("a run can be too long")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(SHARDS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    runs = rows.select(key, sub, "text").mapInArrow(_spans(sentences, min_words, shards), "shard int, packed binary")
    return runs.groupBy("shard").applyInArrow(_meet, "doc long, sub long, place long")


def deduplicated(docs: DataFrame, keep: list[str], sentences: int = SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns ``keep``, with n_sentences, n_removed and clean_text, what stays of ``text``."""
    key, sub, gone = fresh(docs, "doc_key", "doc_sub", "gone")
    short_batches(docs.sparkSession)
    source = numbered(docs, keep, key, sub)
    # copies of one document have the same ranges, so a set is as long as one text's
    lost = repeated_spans(source, key, sub, sentences, min_words).groupBy("doc", "sub").agg(F.collect_set("place").alias("gone"))
    rows = source.join(lost.select(F.col("doc").alias(key), F.col("sub").alias(sub), F.col("gone").alias(gone)), [key, sub], "left")
    names = rows.columns
    at, gone_at, kept = names.index("text"), names.index(gone), [names.index(c) for c in keep]
    added = [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("clean_text", T.StringType())]

    def run(batches):
        for batch in batches:
            total, removed, texts = [], [], []
            column, places = batch.column(at), batch.column(gone_at)
            for lo, hi, data, offsets in slices(column):
                own = Sentences(data, offsets)
                raw = data.tobytes()
                for i in range(hi - lo):
                    s0, s1 = own.bounds[i], own.bounds[i + 1]
                    total.append(int(s1 - s0))
                    if not places[lo + i].is_valid:
                        removed.append(0)
                        texts.append(column[lo + i].as_py())
                        continue
                    cover = np.zeros(s1 - s0 + 1, np.int64)
                    place = places[lo + i].values.to_numpy()
                    a, b = place >> 32, place & 0xFFFFFFFF
                    np.add.at(cover, a, 1)
                    np.add.at(cover, b, -1)
                    stays = np.cumsum(cover[:-1]) == 0
                    edges = np.append(own.start[own.first[s0:s1]], offsets[i + 1])
                    pieces = [raw[offsets[i] : edges[0]]] + [raw[edges[j] : edges[j + 1]] for j in np.flatnonzero(stays)]
                    removed.append(int((~stays).sum()))
                    texts.append(b"".join(pieces).decode())
            cells = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *cells], [*keep, *(f.name for f in added)])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *added]))


def op2_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", F.col("clean_text").alias("text"), "n_sentences", "n_removed")
