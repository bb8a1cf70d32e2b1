import zlib

import corpus_pipeline as P
import numpy as np
from strandloom.llm import mixing, quality_rules, tokens

from .test_decontaminate import grams
from .test_mixing import water
from .test_simhash import brute_similar

VOCABULARY = [f"w{i}" for i in range(3000)]


def corpus():
    rng = np.random.default_rng(2)
    make = lambda n: " ".join(rng.choice(VOCABULARY, n))
    item = make(30)
    rows = []
    for i in range(120):
        rows.append((i, make(int(rng.integers(40, 200))), "en", f"s{i % 4}", 0))
    base = rows[3][1]
    rows += [(200, base, "en", "s1", 0), (201, base + " x", "en", "s1", 0), (202, make(60) + " " + item + " " + make(60), "en", "s2", 0), (203, "too short", "en", "s0", 0), (204, "a b c d e f g h " * 30, "en", "s0", 0), (205, None, None, None, None)]
    for i in range(210, 250):  # copies that share from two thirds of their shingles to nearly all
        words = rows[int(rng.integers(120))][1].split()
        for at in rng.choice(len(words), int(len(words) * rng.choice((0.01, 0.02, 0.03, 0.05, 0.08))), replace=False):
            words[at] = VOCABULARY[int(rng.integers(3000))]
        rows.append((i, " ".join(words), "en", f"s{i % 4}", 0))
    return rows, item


def test_run_against_plain_stages(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.scored(docs, ["doc_id"]).where("kept").collect()}
    assert {203, 204, 205}.isdisjoint(kept) and len(kept) > 110
    passed = sorted((r for r in rows if r[0] in kept), key=lambda r: r[0])
    stays = set(brute_similar([r[1] for r in passed]))
    assert 10 < len(passed) - len(stays) < 40  # copies close enough leave, others stay
    left = [r for i, r in enumerate(passed) if i in stays]
    left = [r for r in left if 100 * len(grams(item) & grams(r[1])) < 80 * len(grams(item))]
    assert 202 not in {r[0] for r in left} and 200 not in {r[0] for r in left}
    sizes = {}
    for _, text, _, source, _ in left:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    target, taken = water(sizes), {}
    order, copies = {}, {}
    for i, text, _, source, _ in sorted(left, key=lambda r: (r[3], len(r[1].split()), r[0])):
        k = order[source] = order.get(source, 0) + 1
        rank = sorted(sizes).index(source) + 1
        share, shift = target[source] / sizes[source], (rank * 40503 + mixing.SEED * 10007) % 65536 / 65536
        copies[i] = int(np.floor(k * share + shift) - np.floor((k - 1) * share + shift))
        taken[source] = taken.get(source, 0) + copies[i] * len(text.split())
    got = sorted(P.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert {i: n for i, n in copies.items() if n} == {i: sum(r.doc_id == i for r in got) for i in {r.doc_id for r in got}}
    own, texts, start = tokens.encoder(tokens.vocabulary_path()), {r[0]: r[1] for r in rows}, 0
    for r in got:
        ids = [*own.whole.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.collect() == []
    assert P.STAGES[-1][1](spark, empty, str(tmp_path)).collect() == []
