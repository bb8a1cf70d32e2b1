import zlib

import numpy as np
import pyarrow as pa
from strandloom.llm import quality_classifier as C
from strandloom.llm.common import slices


def good(i):
    rng = np.random.default_rng(i)
    return " ".join(rng.choice(["river", "stone", "walks", "over", "the", "light,", "falls.", "under"], rng.integers(20, 90)))


def rows(n):
    out = []
    for i in range(n):
        bad = i % 4 == 0
        out.append((i, good(i).upper().replace(" ", "!!\n") if bad else good(i), "en", "s", 0.5, [1.0]))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, score double, feature array<double>"


def test_features_do_not_depend_on_slices():
    texts = pa.array([None, "", "one", good(1), good(2).upper(), "é" * 50, "x\n" * 300])
    whole = [C.features(d, o) for *_, d, o in slices(texts)]
    apart = [C.features(d, o) for *_, d, o in slices(texts, 1)]
    assert len(whole) == 1 and np.allclose(whole[0], np.concatenate(apart)) and np.isfinite(whole[0]).all()


def test_scores_agree_with_plain_densities(spark):
    df = spark.createDataFrame(rows(300), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in C.scored(df, labels, ["doc_id"]).collect()}
    assert len(got) == 300 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 4 > 0) for i in held]) > 0.95
    x = np.concatenate([C.features(d, o) for *_, d, o in slices(pa.array([r[1] for r in rows(300)]))])
    train = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300)])
    y = np.array([i % 4 > 0 for i in range(300)])
    pooled = sum(np.cov(x[train & (y == c)].T, bias=True) * (train & (y == c)).sum() for c in (0, 1)) / train.sum()
    logs = []
    for c in (0, 1):
        own = x[train & (y == c)]
        s = (1 - C.TO_POOLED) * np.cov(own.T, bias=True) + C.TO_POOLED * pooled
        s = (1 - C.TO_DIAGONAL) * s + C.TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(s))
        dev = x - own.mean(0)
        logs.append(np.log(len(own) / train.sum()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (dev @ np.linalg.inv(s) * dev).sum(1))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose(want, [got[i] for i in range(300)], atol=1e-6)


def test_held_out_labels_change_nothing(spark):
    df = spark.createDataFrame(rows(120), SCHEMA)
    one = [(i, int(i % 4 > 0), 0) for i in range(120)]
    two = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in one]
    a, b = ({r.doc_id: r.score for r in C.scored(df, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), ["doc_id"]).collect()} for x in (one, two))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None), (1, None, None, None, None, None), (None, "some words", None, None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in C.scored(df, none, ["doc_id"]).collect()] == [0.5] * 3
    ones = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in C.scored(df, ones, ["doc_id"]).collect()} == {1.0}
    assert C.scored(df.limit(0), ones, ["doc_id"]).collect() == []
