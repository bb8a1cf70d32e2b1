"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has bit b set when over half of its shingle hashes have
it. Fingerprints link at ``radius`` or fewer differing bits; a class is what links
connect.

Every fingerprint gets a pivot table: its Hamming distances to sixteen fixed
reference fingerprints, a byte each, in two longs. By the triangle inequality
two fingerprints within the radius differ by at most the radius in every
coordinate, so a pair whose largest coordinate difference exceeds it is
discarded on the tables alone; the survivors are verified on the fingerprints.

Pairs that may be compared come from block keys: of ``blocks`` blocks of bits,
at most ``radius`` can hold a difference, so linked fingerprints agree on some
choice of ``blocks - radius`` blocks. Equal fingerprints are one row from the
start. Within a key's bucket the fingerprint of most documents is its leader:
all others are first compared with it, which takes as many comparisons as there
are rows. What is then connected need not be compared again, so the second pass
keeps buckets that still hold several classes and compares only rows outside a
bucket's largest class with the rest, and emits links between classes alone. There the
pivot tables deal the bucket's rows to cells as wide as the radius allows two of the coordinates to differ:
rows meet in equal and neighbouring cells only.
No link between classes is lost, and no bucket emits its pairs; buckets, classes and equal
fingerprints of many rows are dealt to several tasks.

``deduplicated`` is for similar texts, not for near fingerprints: at a similarity of 0.8 over five-word shingles
two fingerprints differ in ten bits on average, too many for block keys. There candidates share a key of
smallest hashes, the pivot tables and fingerprints discard with a radius of ``WIDE_RADIUS``, and the texts' shingle sets
decide.

Defined cases: null and empty texts have no words and fingerprint zero, which
links like any other; a text of fewer words than a shingle is one shingle; a
null doc_id is no candidate for the smallest id of a class (a class of null ids
has a null id); repeated rows have one class; an empty table gives an empty
result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..operators.joins import HOT_ROWS, dealt_join
from .common import MOST_BROADCAST_ROWS, fresh, keyed, mixed, settled, short_batches, stored, table, without

RADIUS = 4
SHINGLE = 4
HASH_SEED = 42
#: Reference fingerprints, drawn once from a seeded generator.
PIVOTS = [int(x) for x in np.random.default_rng(7).integers(-(2**63), 2**63, 16, dtype=np.int64)]
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes split at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - size + 1)
    last = ends[size - 1 :] if len(words) >= size else ends[-1:]
    return np.fromiter((hashed(joined[a:b], HASH_SEED) for a, b in zip(first[:k].tolist(), last.tolist())), np.uint64, k)


def fingerprint(text: str | None) -> int:
    return majority_bits(shingle_hashes(text))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have, as a signed 64-bit number."""
    k = len(hashes)
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, k, 1 << 16):
        set_bits += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > k, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` and the fingerprint of ``text``."""
    source = docs.select(*dict.fromkeys([*keep, "text"]))
    at, kept = source.columns.index("text"), [source.columns.index(c) for c in keep]

    def run(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(at)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(prints)], [*keep, name])

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in keep), T.StructField(name, T.LongType())]))


def blocks_for(rows: int, radius: int = RADIUS) -> int:
    """Three blocks to agree on, one more from 5 million fingerprints and for each twentyfold beyond: a key's chance partners stay rare, results equal."""
    chosen = 3
    while rows > 5_000_000 * 20 ** (chosen - 3):
        chosen += 1
    return radius + chosen


def block_keys(fp, blocks: int, radius: int = RADIUS) -> F.Column:
    """One key for each choice of blocks that must agree; the choice's number is part of the key."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(part[i])
        keys.append(key)
    return F.explode(F.array(*keys))


def pivot_table(fp) -> list[F.Column]:
    out = []
    for lo in range(0, len(PIVOTS), 8):
        packed = F.lit(0).cast("long")
        for i, pivot in enumerate(PIVOTS[lo : lo + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(pivot))).cast("long"), 8 * i))
        out.append(packed)
    return out


def near(a: str, b: str, radius: int = RADIUS) -> F.Column:
    """Pivot coordinates first, then the fingerprints; a and b prefix the columns fp, t0, t1."""
    ok = F.lit(True)
    for t in ("t0", "t1"):
        for i in range(8):
            x, y = (F.shiftrightunsigned(F.col(f"{p}{t}"), 8 * i).bitwiseAND(F.lit(255)) for p in (a, b))
            ok = ok & (F.abs(x - y) <= radius)
    return ok & (F.bit_count(F.col(f"{a}fp").bitwiseXOR(F.col(f"{b}fp"))) <= radius)


def cells(table: str, radius: int) -> list[F.Column]:
    """The first two pivot coordinates in steps of radius + 1: two fingerprints within the radius are one step apart at most in each."""
    return [F.floor(F.shiftrightunsigned(F.col(table), 8 * i).bitwiseAND(F.lit(255)) / (radius + 1)).cast("int") for i in (0, 1)]


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, class) for (fp, n) rows with one row for each fingerprint; a class is named by its lowest fingerprint."""
    t0, t1 = pivot_table(F.col("fp"))
    tables = settled(prints.select("fp", "n", t0.alias("t0"), t1.alias("t1")))
    total = tables.count()
    blocks = blocks_for(total, radius)
    keyed = tables.select(block_keys(F.col("fp"), blocks, radius).alias("key"), "fp", "n", "t0", "t1")
    leaders = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct("n", "fp", "t0", "t1")).alias("leader")).where("rows > 1")
    held = leaders.select("key", *(F.col(f"leader.{c}").alias(f"l_{c}") for c in ("fp", "t0", "t1")))
    shared = settled(dealt_join(keyed.drop("n"), held, ["key"], total * comb(blocks, radius), leaders.select("key", F.col("rows").alias("n"))))
    stars = shared.where(F.col("fp") != F.col("l_fp")).where(near("", "l_", radius)).select(F.col("fp").alias("src"), F.col("l_fp").alias("dst"))
    first = settled(connected_components(stars)).withColumnsRenamed({"node": "fp", "component": "class"})
    rows = settled(shared.select("key", "fp", "t0", "t1").join(first, "fp", "left").withColumn("class", F.coalesce("class", "fp")))
    sizes = rows.groupBy("key", "class").agg(F.count(F.lit(1)).alias("rows"))
    main = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max_by("class", F.struct("rows", "class")).alias("main"), F.sum("rows").alias("n")).where("classes > 1")
    x, y = cells("t0", radius)
    open_rows = settled(dealt_join(rows, main.select("key", "main"), ["key"], total * comb(blocks, radius), main.select("key", "n")).withColumns({"x": x, "y": y}))
    near_by = F.array(*(F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    outside = open_rows.where(F.col("class") != F.col("main")).withColumn("cell", F.explode(near_by)).select("key", "cell.x", "cell.y", *(F.col(c).alias(f"o_{c}") for c in ("fp", "t0", "t1", "class")))
    links = dealt_join(open_rows.drop("main"), outside, ["key", "x", "y"], open_rows.count()).where((F.col("class") != F.col("o_class")) & near("", "o_", radius))
    second = connected_components(links.select(F.col("o_class").alias("src"), F.col("class").alias("dst")))
    second = settled(second).withColumnsRenamed({"node": "class", "component": "joined"})
    named = tables.select("fp").join(first, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    return dealt_join(named, second, ["class"], total, how="left").select("fp", F.coalesce("joined", "class").alias("class"))


#: Similar texts: words in a shingle, least share of shingles in common, and most differing bits that a pair may have to be
#: looked at (two texts that share just 0.8 of their shingles differ in 10 bits on average, in over 20 once in some thousands).
WIDE_SHINGLE, SIMILAR, WIDE_RADIUS = 5, 0.8, 20
#: Of the smallest hashes under each of BANDS * BAND_ROWS orders, BAND_ROWS make a key.
BANDS, BAND_ROWS = 18, 5
_TURN = np.random.default_rng(13).integers(0, 2**63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys that two sets share with a probability of 1 - (1 - similarity ** BAND_ROWS) ** BANDS for one at least: 0.999 at 0.8."""
    least = np.full(BANDS * BAND_ROWS, np.uint64(2**64 - 1))
    for lo in range(0, len(shingles), 4096):
        np.minimum(least, mixed(shingles[lo : lo + 4096, None] * _TURN[0] + _TURN[1]).min(0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ row)
    return key.view(np.int64)


def sketches(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the shingle set's 128-bit hash (h, g), its size n, fingerprint fp and band keys."""
    source = docs.select(*keep, "text")

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column(len(keep)):
                own = np.unique(shingle_hashes(x.as_py(), WIDE_SHINGLE))
                whole = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                rows.append((*whole.tolist(), len(own), majority_bits(own), band_keys(own) if len(own) else []))
            cells = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(c, pa.int64()) for c in cells[:4]), pa.array(cells[4], pa.list_(pa.int64()))], [*keep, "h", "g", "n", "fp", "bands"])

    added = [T.StructField(c, T.LongType()) for c in ("h", "g", "n", "fp")] + [T.StructField("bands", T.ArrayType(T.LongType()))]
    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in keep), *added]))


def _similar(batches):
    """Rows come by a, with a's own text first: the pairs whose shingle sets are similar."""
    current, own = None, None
    for batch in batches:
        src, dst = [], []
        for a, copy, b, text in zip(*(batch.column(i) for i in range(4))):
            a, copy, b = a.as_py(), copy.as_py(), b.as_py()
            found = np.unique(shingle_hashes(text.as_py(), WIDE_SHINGLE))
            if b is None:
                current, own = (a, copy), found
                continue
            if current != (a, copy):
                raise RuntimeError("a text without the one it is compared with")
            both = len(np.intersect1d(own, found, assume_unique=True))
            if both >= SIMILAR * (len(own) + len(found) - both):
                src.append(a)
                dst.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def similar_pairs(texts: DataFrame, rid: str, pairs: DataFrame) -> DataFrame:
    """(src, dst): the pairs (a, b) of row numbers whose texts are similar; the texts of a frequent a's partners are dealt to copies of a."""
    sizes = settled(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HOT_ROWS).cast("int").alias("copies")))
    dealt = dealt_join(pairs, sizes, ["a"], pairs.count()).select(F.col("b").alias("rid"), "a", F.pmod(F.xxhash64("b"), "copies").cast("int").alias("copy"), "b")
    heads = sizes.select(F.col("a").alias("rid"), "a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("b"))
    asked = settled(dealt.unionByName(heads))
    asked = F.broadcast(asked) if asked.count() <= MOST_BROADCAST_ROWS else asked
    rows = texts.select(F.col(rid).alias("rid"), "text").join(asked, "rid").select("a", "copy", "b", "text")
    return settled(rows.repartition("a", "copy").sortWithinPartitions("a", "copy", F.col("b").isNotNull()).mapInArrow(_similar, "src long, dst long"))


def _may_be_similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes, pivot tables and fingerprints do not rule out; an a can have many partners, so its pairs are dealt out."""
    pairs = settled(pairs)
    first, second = (sets.select(F.col("rid").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("n", "fp", "t0", "t1"))) for side in "ab")
    both = dealt_join(pairs, first, ["a"], pairs.count(), pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))).join(second, "b")
    sizes = F.least("a_n", "b_n") >= SIMILAR * F.greatest("a_n", "b_n")
    return settled(both.where(sizes & near("a_", "b_", WIDE_RADIUS)).select("a", "b"))


def similar_classes(texts: DataFrame, sets: DataFrame, rid: str) -> DataFrame:
    """(rid, class) of the rows of ``sets`` (rid, n, fp, bands; one for each different shingle set) that have a similar one.

    Candidates share a band key. As in ``classes``, a bucket's rows are first compared with one leader, and then
    those outside its largest class with the rows of other classes, in blocks that no pair leaves. Pivot tables and
    fingerprints discard, and the shingle sets of the texts decide.
    """
    t0, t1 = pivot_table(F.col("fp"))
    sets = settled(sets.select("rid", "n", "fp", "bands", t0.alias("t0"), t1.alias("t1")))
    total = sets.count()
    keyed = sets.select("rid", F.explode("bands").alias("key"))
    leaders = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("rid").alias("a")).where("rows > 1")
    shared = settled(dealt_join(keyed, leaders.select("key", "a"), ["key"], total * BANDS, leaders.select("key", F.col("rows").alias("n"))))
    pairs = shared.where(F.col("rid") != F.col("a")).select("a", F.col("rid").alias("b")).distinct()
    links = similar_pairs(texts, rid, _may_be_similar(pairs, sets))
    first = settled(connected_components(links)).withColumnsRenamed({"node": "rid", "component": "class"})
    rows = settled(shared.select("key", "rid").join(first, "rid", "left").withColumn("class", F.coalesce("class", "rid")))
    held = rows.groupBy("key", "class").agg(F.count(F.lit(1)).alias("rows"))
    main = held.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max_by("class", F.struct("rows", "class")).alias("main"), F.sum("rows").alias("n")).where("classes > 1")
    open_rows = settled(dealt_join(rows, main.select("key", "main"), ["key"], total * BANDS, main.select("key", "n")))
    more = linked_classes(texts, sets, rid, open_rows)
    return connected_components(links.unionByName(more)).withColumnsRenamed({"node": "rid", "component": "class"})


#: Rows and shingles in one side of a block of a bucket, about.
SIDE_ROWS, SIDE_SHINGLES = 1024, 1 << 21
#: Pairs of a block up to which shingle sets are compared pair by pair, and columns of the table that compares all of them beyond.
FEW_PAIRS, COLUMNS = 64, 4096


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of ``a`` has in common with each of ``b``."""
    sizes = np.array([len(x) for x in (*a, *b)])
    values, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    met = np.bincount(code, minlength=len(values)) > 1  # what one set alone has is in common with nothing
    code, row = (np.cumsum(met) - 1)[code[met[code]]], row[met[code]]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(met.sum()), COLUMNS):
        x, y = np.searchsorted(code, (lo, lo + COLUMNS))
        has = np.zeros((len(sizes), COLUMNS), np.float32)
        has[row[x:y], code[x:y] - lo] = 1
        out += has[: len(a)] @ has[len(a) :].T
    return out


def _linked(batches):
    """Rows of one block of a bucket at a time: which classes of those that ask hold a text similar to one of another class.

    Pivot tables and fingerprints discard first; of what is left, the shingle sets decide. No pair leaves the task,
    only pairs of classes.
    """
    for rows in keyed(batches, ["key", "i", "j"]):
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
        src = dst = np.zeros(0, np.int64)
        if len(one) and len(two):
            own, n, fp = (rows.column(c).to_numpy() for c in ("class", "n", "fp"))
            t = np.concatenate([rows.column(c).to_numpy().view(np.uint8).reshape(-1, 8) for c in ("t0", "t1")], 1).astype(np.int16)
            near = own[one][:, None] != own[two][None]
            near &= np.minimum(n[one][:, None], n[two][None]) >= SIMILAR * np.maximum(n[one][:, None], n[two][None])
            for c in range(t.shape[1]):
                near &= np.abs(t[one, c][:, None] - t[two, c][None]) <= WIDE_RADIUS
            near &= np.bitwise_count(fp[one][:, None] ^ fp[two][None]) <= WIDE_RADIUS
            i, j = np.nonzero(near)
            if len(i):
                lists = rows.column("shingles").combine_chunks()
                edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                sets = lambda at: [flat[edges[x] : edges[x + 1]] for x in at]
                if len(i) <= FEW_PAIRS:
                    both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sets(one[i]), sets(two[j]))])
                else:
                    both = _common(sets(one), sets(two))[i, j].astype(np.int64)
                hit = both >= SIMILAR * (n[one[i]] + n[two[j]] - both)
                ends = np.unique(np.stack([own[one[i[hit]]], own[two[j[hit]]]], 1), axis=0)
                src, dst = ends[:, 0], ends[:, 1]
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])


def with_shingles(texts: DataFrame, rid: str, rows: DataFrame) -> DataFrame:
    """``rows`` (rid, n, fp, t0, t1) with their texts' shingle sets, as hashes."""
    source = rows.join(texts.select(F.col(rid).alias("rid"), "text"), "rid").select("rid", "n", "fp", "t0", "t1", "text")

    def run(batches):
        for batch in batches:
            own = [np.unique(shingle_hashes(x.as_py(), WIDE_SHINGLE)).view(np.int64) for x in batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own, pa.list_(pa.int64()))], [*batch.schema.names[:5], "shingles"])

    return source.mapInArrow(run, "rid long, n long, fp long, t0 long, t1 long, shingles array<long>")


def linked_classes(texts: DataFrame, sets: DataFrame, rid: str, open_rows: DataFrame) -> DataFrame:
    """(src, dst): classes that a similar pair connects, for buckets (key) of rows (rid, class) of several classes, the largest of them ``main``.

    Rows outside the largest class meet all rows of their bucket, in blocks of bounded size.
    """
    facts = stored(with_shingles(texts, rid, sets.select("rid", "n", "fp", "t0", "t1").join(open_rows.select("rid").distinct(), "rid", "left_semi")), "shingles")
    rows = open_rows.join(sets.select("rid", "n"), "rid")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / SIDE_ROWS), F.ceil(F.sum("n") / SIDE_SHINGLES)).cast("int")
    parts = settled(rows.groupBy("key").agg(parts.alias("parts"), F.count(F.lit(1)).alias("rows")))
    held = dealt_join(open_rows, parts.select("key", "parts"), ["key"], open_rows.count(), parts.select("key", F.col("rows").alias("n")))
    own, every = F.pmod(F.xxhash64("rid"), "parts").cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asks = held.where(F.col("class") != F.col("main")).withColumn("i", own).withColumn("j", every).withColumn("asks", F.lit(True))
    homes = held.withColumn("j", own).withColumn("i", every).withColumn("asks", F.lit(False))
    both = asks.select("key", "i", "j", "asks", "rid", "class").unionByName(homes.select("key", "i", "j", "asks", "rid", "class")).join(facts, "rid")
    met = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_linked, "src long, dst long")
    return settled(met.distinct())


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class of similar texts (five-word shingles, 0.8 of them in common, directly or by way of others).

    Stays: the smallest doc_id (null last), the first of repeated rows. Texts without words are one class.
    Texts go into the tasks' Python but not out of it: rows are numbered, and the numbers of the others leave.
    """
    (rid,) = fresh(docs, "row_number")
    short_batches(docs.sparkSession)
    kept = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "simhash")
    found = settled(sketches(kept.select(F.col(rid).alias("rid"), "doc_id", "text"), ["rid", "doc_id"]))
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "rid")
    sets = settled(found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(best.alias("best"), "n", "fp", "bands")).alias("own")).select("h", "g", "own.*", "rows"))
    sets = sets.withColumn("rid", F.col("best.rid"))
    classes_ = settled(similar_classes(kept, sets, rid))
    whole = sets.select("rid", "best").join(classes_, "rid")
    stays = whole.groupBy("class").agg(F.min("best").alias("stays"))
    beaten = dealt_join(whole, stays, ["class"], sets.count()).where(F.col("best") != F.col("stays")).select("rid")
    first = sets.select("rid").join(beaten, "rid", "left_anti")
    gone = found.select("rid").join(first, "rid", "left_anti").select(F.col("rid").alias(rid))
    return without(kept, gone, rid).select(*docs.columns)


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settled(with_fingerprints(table(spark, sf_dir, "documents"), ["doc_id"], "fp"))
    prints = settled(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")))
    named = settled(prints.join(classes(prints.select("fp", "n")), "fp"))
    ids = named.groupBy("class").agg(F.min("first").alias("component_id"))
    whole = dealt_join(named.select("fp", "class"), ids, ["class"], named.count()).select("fp", "component_id")
    return dealt_join(rows, whole, ["fp"], rows.count(), prints.select("fp", "n")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
