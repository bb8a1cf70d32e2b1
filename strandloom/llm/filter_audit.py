"""What each of five filters removes, in every order in which they can be applied.

A document's failures are a mask of five bits. Documents are counted once for each
cell (part, mask); a cell's documents share one fate, so every order of the filters is
folded over cells, not over documents: ``transform`` goes through the constant array of all 120
orders, ``aggregate`` carries a cell through the five steps of one, and the 600 resulting structs,
weighted with the cell's counts, are merged by sums for each position. There are 32 cells a part at most.

All of it is DataFrame functions. Filter E compares texts by SHA-256 and length, not by
the texts themselves; rows of a text that very many documents share are dealt to several tasks.

Defined cases: a null text is the empty text and has no words, so it fails A and not B (0 < 0) nor C; a null doc_id has no smaller
one and is smaller than none, so it neither fails E nor makes another fail it; repeated rows of one
doc_id do not fail E for each other; of several labels of a doc_id, one that says 1 is enough; a null lang
and an empty one are one part; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import dealt_join
from .common import WORD_PATTERN, settled, table

FILTERS = "ABCDE"
#: Every order of the filters, each a string of letters.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def own_failures(text: Column) -> dict[str, Column]:
    """Filters A to D of a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of every document; bit i of the mask is set where filter i of ``FILTERS`` rejects it."""
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(own_failures(text).values())), F.lit(0))
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("same"), F.length(text).alias("size"))
    own = settled(own)
    total = own.count()
    groups = own.groupBy("same", "size").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = settled(groups)
    judged = dealt_join(own, groups.select("same", "size", "first"), ["same", "size"], total, groups, how="left")
    bit = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << FILTERS.index("E"))).otherwise(0)
    judged = judged.select("doc_id", "part", (F.col("mask") + bit).alias("mask"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    nameless = judged.where("doc_id is null").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    named = dealt_join(judged.where("doc_id is not null"), known, ["doc_id"], total, how="left")
    return named.fillna(False, ["good", "toxic"]).unionByName(nameless)


def _fold(order: Column) -> Column:
    """The five steps of an order (bit values) for one cell: structs that hold how many of the cell's documents meet each fate."""
    nobody = F.lit(0).cast("long")
    among = lambda met, of="n": F.when(met, F.col(of)).otherwise(nobody)

    def step(state: Column, bit: Column) -> Column:
        alive, fails = state["alive"], F.col("mask").bitwiseAND(bit) != 0
        counts = [among(alive & ~fails), among(alive & fails), among(~alive & fails), among(F.col("mask") == bit), among(alive & fails, "good"), among(alive & fails, "toxic")]
        own = F.struct(*(c.alias(name) for c, name in zip(counts, COUNTS)))
        return F.struct((alive & ~fails).alias("alive"), F.array_append(state["steps"], own).alias("steps"))

    steps = F.array().cast(f"array<struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>>")
    return F.aggregate(order, F.struct(F.lit(True).alias("alive"), steps.alias("steps")), step, lambda state: state["steps"])


def audit(judged: DataFrame) -> DataFrame:
    """One row for each part, order and step from (part, mask, good, toxic) of documents."""
    sums = [F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")]
    cells = settled(judged.groupBy("part", "mask").agg(*sums))
    orders = F.lit([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    folded = cells.select("part", F.posexplode(F.flatten(F.transform(orders, _fold))).alias("at", "fate"))
    merged = folded.groupBy("part", "at").agg(*(F.sum(f"fate.{c}").alias(c) for c in COUNTS))
    named = merged.withColumns({"filter_order": F.element_at(F.lit(ORDERS), F.floor(F.col("at") / len(FILTERS)).cast("int") + 1), "step": (F.col("at") % len(FILTERS) + 1).cast("int")})
    own = Window.partitionBy("part", F.substr("filter_order", "step", F.lit(1)))
    return named.select("part", "filter_order", "step", *COUNTS, F.sum("removed").over(own).alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
with own as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), firsts as (select body, min(doc_id) as first_id from own group by body
), known as (select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels group by doc_id
), judged as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 10 * length(body),
     regexp_matches(body, '[#$%&*|]'), coalesce(own.doc_id > first_id, false)] as fails
  from own join firsts using (body) left join known on own.doc_id = known.doc_id
), cells as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from judged group by part, fails
), letters as (select unnest(range(1, 6)) as i
), orders as (
  select [a.i, b.i, c.i, d.i, e.i] as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps as (
  select part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') as filter_order, s.i as step, o[s.i] as f, n, good, toxic, fails[o[s.i]] as fails,
    len(list_filter(o[1:s.i - 1], lambda x: fails[x])) = 0 as alive, len(list_filter(fails, lambda x: x)) = 1 as lone
  from cells, orders, letters s
), summed as (
  select part, filter_order, cast(step as integer) as step, any_value(f) as f,
    cast(coalesce(sum(n) filter (alive and not fails), 0) as bigint) as kept, cast(coalesce(sum(n) filter (alive and fails), 0) as bigint) as removed,
    cast(coalesce(sum(n) filter (not alive and fails), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (fails and lone), 0) as bigint) as unique_fails,
    cast(coalesce(sum(good) filter (alive and fails), 0) as bigint) as good_lost, cast(coalesce(sum(toxic) filter (alive and fails), 0) as bigint) as toxic_lost
  from steps group by part, filter_order, step
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from summed
"""
