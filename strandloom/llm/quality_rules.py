"""Quality rules: plain text statistics and an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model over UTF-8 bytes (five at a
time, white space as one symbol, one model per value of ``lang``). Tasks count
their n-grams, Spark adds the counts up, derives the continuation counts,
discounts and interpolated probabilities with joins and windows, and the result
is gathered as sorted arrays of n-grams (five bytes and the hash of the language)
and their log probabilities. No n-gram is dropped or shares its place with another,
so the model grows with the number of different n-grams. Arrays of more than
``SLICE_GRAMS`` entries go round in slices: each slice is broadcast on its own, a pass
over the texts adds what its n-grams are worth, and the sums of all passes are the
same as those of one. Two languages share a model if 23 bits of their hashes agree.

Perplexity is stated per word: 2 to the mean number of bits a word takes. A
document is rejected when its bits a word lie outside its language's band,
``q25 - width * (q75 - q25)`` to ``q75 + width * (q75 - q25)`` of that language.

Defined cases: null text counts as empty; an empty text has zero statistics, no
perplexity, and fails the base rule. Perplexity ends at 2**1023, which a very long word can
reach; bits_per_word does not. A null ``lang`` is a language of its own. Repeated rows
are judged alike. An empty table gives an empty result. Columns beside text and
lang pass through untouched.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, MOST_BROADCAST_ROWS, codes, fresh, pair_codes, per_text, settled, short_batches, slices, spans, stored, table, without

ORDER = 5
LANG_SHIFT = 8 * ORDER
LANG_BITS = 23
#: n-grams of the model that one broadcast holds.
SLICE_GRAMS = 8_000_000
BAND_WIDTH = 3.0
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def lang_code() -> F.Column:
    """A number below 2**23 for each language; null has one too."""
    return F.pmod(F.xxhash64(F.coalesce("lang", F.lit("\x00"))), F.lit(1 << LANG_BITS))


def packed(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each byte, with its language's code on top; a text is preceded by zero bytes."""
    n = len(offsets) - 1
    which = np.repeat(np.arange(n), np.diff(offsets))
    at = np.arange(len(data)) + (ORDER - 1) * (which + 1)
    padded = np.zeros(len(data) + (ORDER - 1) * n, np.int64)
    padded[at] = np.where(IS_SPACE[data], 32, data)
    key = padded.copy()
    for back in range(1, ORDER):
        key[back:] |= padded[:-back] << (8 * back)
    return key[at] | (langs[which] << LANG_SHIFT)


def count_batches(batches):
    """Each task's own n-gram counts, merged whenever a few million are at hand."""
    keys, counts, held = [], [], 0

    def merge():
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return [k], [np.bincount(inverse, np.concatenate(counts)).astype(np.int64)]

    for batch in batches:
        langs = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in slices(batch.column(0)):
            if not len(data):
                continue
            code, values = pd.factorize(packed(data, offsets, langs[lo:hi]))
            keys.append(values)
            counts.append(np.bincount(code))
            held += len(values)
            if held > 3_000_000:
                keys, counts = merge()
                held = len(keys[0])
    if keys:
        keys, counts = merge()
        for lo in range(0, len(keys[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[0][lo : lo + 100_000]), pa.array(counts[0][lo : lo + 100_000])], ["gram", "n"])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n) of all documents."""
    return docs.select("text", lang_code()).mapInArrow(count_batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _part(order: int):
    low, lang = (1 << 8 * order) - 1, -1 << LANG_SHIFT
    return lambda c: c.bitwiseAND(F.lit(lang | low))


def _context():
    lang, low = -1 << LANG_SHIFT, (1 << LANG_SHIFT) - 1
    return F.col("gram").bitwiseAND(F.lit(lang)).bitwiseOR(F.shiftright(F.col("gram").bitwiseAND(F.lit(low)), 8))


def estimated(counts: DataFrame) -> list[DataFrame]:
    """For each order (gram, ctx, p, gamma): interpolated probability, and the weight its context gives to the next lower order."""
    by_order = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: how many different bytes precede
        by_order[order] = settled(by_order[order + 1].select(_part(order)(F.col("gram")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    out: list[DataFrame] = []
    for order in range(1, ORDER + 1):
        own = by_order[order].withColumn("ctx", _context()).withColumn("lang", F.shiftright("gram", LANG_SHIFT))
        tally = own.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        rule = [F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5 * i)))) for i in (1, 2, 3)]
        y_ok = F.col("n1") + F.col("n2") > 0
        discounts = tally.select("lang", *(F.when(y_ok, r).otherwise(0.5 * i).alias(f"d{i}") for i, r in zip((1, 2, 3), rule)))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        followers = Window.partitionBy("ctx")  # at most 256 rows: the bytes that can follow
        own = own.join(F.broadcast(discounts), "lang").withColumn("cut", cut)  # one row per 23-bit language code
        own = own.withColumn("total", F.sum("n").over(followers)).withColumn("gamma", F.sum("cut").over(followers) / F.col("total"))
        direct = (F.col("n") - F.col("cut")) / F.col("total")
        if order == 1:
            own = own.withColumn("p", direct + F.col("gamma") / 256)
        else:
            lower = out[-1].select(F.col("gram").alias("suffix"), F.col("p").alias("p_low"))
            own = own.withColumn("suffix", _part(order - 1)(F.col("gram"))).join(lower, "suffix").withColumn("p", direct + F.col("gamma") * F.col("p_low"))
        out.append(own.select("gram", "ctx", "p", "gamma"))
    return out


class Sorted:
    """Values under sorted keys."""

    def __init__(self, rows: pa.Table):
        keys, values = (rows.column(i).to_numpy() for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where there is none."""
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(keys), np.nan, np.float32)
        here = np.flatnonzero(at < len(self.keys))
        here = here[self.keys[at[here]] == keys[here]]
        out[here] = self.values[at[here]]
        return out


def log_probabilities(top: DataFrame, number: int = 0, slices_: int = 1) -> Sorted:
    """One slice of the highest order's log2 p."""
    own = top if slices_ == 1 else top.where(F.pmod(F.xxhash64("gram"), F.lit(slices_)) == number)
    return Sorted(own.select("gram", F.log2("p").cast("float")).toArrow())


class Model:
    """All orders, for texts that need not be among those that were counted: an unknown n-gram backs off."""

    def __init__(self, orders: list[DataFrame]):
        self.grams = [log_probabilities(own) for own in orders]
        self.weights = [Sorted(own.select("ctx", F.log2("gamma").cast("float")).distinct().toArrow()) for own in orders]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        lang, low = keys >> LANG_SHIFT << LANG_SHIFT, keys & ((1 << LANG_SHIFT) - 1)
        out = np.full(len(keys), np.nan, np.float32)
        spent, todo = np.zeros(len(keys), np.float32), np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            gram = low[todo] & ((1 << 8 * order) - 1)
            found = self.grams[order - 1](lang[todo] | gram) + spent
            known = ~np.isnan(found)
            out[todo[known]] = found[known]
            spent = (spent + np.nan_to_num(self.weights[order - 1](lang[todo] | (gram >> 8))))[~known]
            todo = todo[~known]
        out[todo] = spent - 8
        return out


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base rule's counts for each text of a slice."""
    n = len(offsets) - 1
    inside = ~IS_SPACE[data]
    start, end = spans(inside, offsets)
    first = np.searchsorted(start, offsets)  # a text's first word
    n_words = np.diff(first)
    owner = np.repeat(np.arange(n), n_words)
    # lines
    is_break = data == 10
    breaks = np.flatnonzero(is_break)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_text = np.repeat(np.arange(n), per_text(is_break, offsets) + 1)
    line_end = np.sort(np.concatenate([offsets[1:], breaks]))
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=words_before[1:])
    filled = words_before[line_end] > words_before[line_start]
    line = codes(data, line_start, line_end) * n + line_text
    again = np.zeros(len(line), bool)
    again[filled] = pd.Series(line[filled]).duplicated().to_numpy()
    n_dup_lines = np.bincount(line_text[again], minlength=n)
    # windows of words
    word = run = codes(data, start, end)
    reach = 1
    while reach < WINDOW:
        run = pair_codes(run[:-reach], run[reach:]) if len(run) > reach else run[:0]
        reach *= 2
    whole = owner[: len(run)] == owner[WINDOW - 1 :] if len(run) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    twice = at[pd.Series(run[at] * n + owner[at]).duplicated(keep=False).to_numpy()]
    cover = np.zeros(len(word) + 1, np.int64)
    cover[twice] += 1
    cover[twice + WINDOW] -= 1
    repeated = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": n_words,
        "word_chars": per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(SYMBOLS[data], offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": np.bincount(owner[repeated], minlength=n),
    }


def _bits(values: Sorted, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """The bits that each text takes, as far as these n-grams go; each different n-gram is looked up once."""
    if not len(data):
        return np.zeros(len(offsets) - 1)
    code, different = pd.factorize(packed(data, offsets, langs))
    return -per_text(np.nan_to_num(values(different)).astype(np.float64)[code], offsets)


def score_batches(shared, with_stats: bool, kept: int, names: list[str]):
    """Columns: those to keep, text, language code."""

    def run(batches):
        for batch in batches:
            langs = batch.column(kept + 1).to_numpy(zero_copy_only=False)
            parts: dict[str, list] = {k: [] for k in (*STATS[: len(STATS) * with_stats], "bits")}
            for lo, hi, data, offsets in slices(batch.column(kept)):
                if with_stats:
                    for k, v in text_stats(data, offsets).items():
                        parts[k].append(v)
                parts["bits"].append(_bits(shared.value, data, offsets, langs[lo:hi]))
            cells = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.float64() if k == "bits" else pa.int64()) for k, v in parts.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), *cells], names)

    return run


def _pass(docs: DataFrame, keep: list[str], bits: str, values: Sorted, with_stats: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(values)
    stats = STATS[: len(STATS) * with_stats]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in stats] + [T.StructField(bits, T.DoubleType())])
    out = settled(docs.select(*keep, "text", lang_code()).mapInArrow(score_batches(shared, with_stats, len(keep), schema.names), schema))
    shared.unpersist()
    return out


def measured(docs: DataFrame, keep: list[str], bits: str, slice_grams: int = SLICE_GRAMS) -> DataFrame:
    """The columns ``keep`` with the statistics and the bits of the whole text."""
    top = settled(estimated(settled(gram_counts(docs)))[-1].select("gram", "p"))
    count = -(-top.count() // slice_grams)
    if count <= 1:
        return _pass(docs, keep, bits, log_probabilities(top), True)
    rid, more = fresh(docs, "row_number", "more_bits")
    docs = stored(docs.select(*dict.fromkeys([*keep, "text", "lang"])).withColumn(rid, F.monotonically_increasing_id()), "quality-rules")
    first = _pass(docs, [*keep, rid], bits, log_probabilities(top, 0, count), True)
    rest = [_pass(docs, [rid], more, log_probabilities(top, i, count), False) for i in range(1, count)]
    sums = reduce(DataFrame.unionByName, rest).groupBy(rid).agg(F.sum(more).alias(more))
    return settled(first.join(sums, rid).withColumn(bits, F.col(bits) + F.col(more)).drop(rid, more))


def scored(docs: DataFrame, keep: list[str], width: float = BAND_WIDTH, slice_grams: int = SLICE_GRAMS) -> DataFrame:
    """The columns ``keep`` with the statistics, perplexity, base_failed and kept."""
    lang_out, bits, lo_name, hi_name = fresh(docs, "lang_key", "bits", "band_low", "band_high")
    rows = measured(docs, list(dict.fromkeys([*keep, "lang"])), bits, slice_grams)
    key = F.coalesce(F.col("lang"), F.lit("\x00null"))
    rows = rows.withColumn(lang_out, key).withColumn(bits, F.when(F.col("n_words") > 0, F.col(bits) / F.col("n_words")))
    quart = rows.where(F.col(bits).isNotNull()).groupBy(lang_out).agg(F.percentile_approx(bits, F.array(F.lit(0.25), F.lit(0.75)), 100_000).alias("q"))
    spread = F.col("q")[1] - F.col("q")[0]
    bands = settled(quart.select(lang_out, (F.col("q")[0] - width * spread).alias(lo_name), (F.col("q")[1] + width * spread).alias(hi_name)))
    bands = F.broadcast(bands) if bands.count() <= MOST_BROADCAST_ROWS else bands  # a row for each language
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    inside = F.coalesce(F.col(bits).between(F.col(lo_name) - 1e-9, F.col(hi_name) + 1e-9), F.lit(False))
    perplexity = F.pow(F.lit(2.0), F.least(F.col(bits), F.lit(1023.0)))
    return rows.join(bands, lang_out, "left").select(
        *keep, *STATS, failed.alias("base_failed"), (~failed & inside).alias("kept"), F.col(bits).alias("bits_per_word"), F.when(F.col(bits).isNotNull(), perplexity).alias("perplexity"), F.col(lo_name).alias("band_low"), F.col(hi_name).alias("band_high")
    )


def filtered(docs: DataFrame, width: float = BAND_WIDTH) -> DataFrame:
    """The documents that the rules keep, with their own columns only.

    Texts go into the tasks' Python but not out of it: rows are numbered, and the numbers of the rejected ones leave.
    """
    (rid,) = fresh(docs, "row_number")
    short_batches(docs.sparkSession)
    kept = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "quality-rules")
    verdicts = scored(kept.select(F.col(rid).alias("rid"), "text", "lang"), ["rid"], width)
    return without(kept, verdicts.where("not kept").select(F.col("rid").alias(rid)), rid).select(*docs.columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
