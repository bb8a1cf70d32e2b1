import hashlib

import numpy as np
from strandloom.llm import line_dedup as L
from strandloom.llm.perfect_hash import PerfectHash

THUE = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(2048)) for k in (0, 1)]
WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    owner = {}
    order = lambda d: (d is None, d or 0)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            k = line.strip(WS).translate(LOWER)
            owner[k] = min(owner.get(k, doc), doc, key=order)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(WS).translate(LOWER)) < 10 or owner[k] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return sorted(out, key=repr)


def test_perfect_hash():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        one = PerfectHash.of(keys)
        again = PerfectHash.load(one.dump())
        assert sorted(again(keys).tolist()) == list(range(len(keys))) == sorted(one(keys).tolist())


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 20)
    monkeypatch.setattr(L, "SHARD_PROBES", 30)
    common = "The most COMMON line of all"
    rows = [(i, f"{common}\nline number {i % 37} of many\n \nshort\r\n{common.upper()}\t\nonly in {i} here", "x", 1) for i in range(150)]
    rows += [(500, None, None, None), (501, "", None, None), (None, common, None, None), (None, "only without an id", None, None), (3, "line number 5 of many\nonly in 3 here", "x", 1), (502, "\n" * 5, "x", 1), (503, "é" * 9 + "\n" + "É" * 10 + "\n", "x", 1), (504, "É" * 10 + "\nonly without an id", "x", 1), (505, ("long line again and again " * 2000 + "\n") * 3, "x", 1), (506, THUE[0], "x", 1), (507, THUE[1], "x", 1), (508, THUE[0] + "\n" + THUE[1], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, doc_key int")
    got = [tuple(r) for r in L.deduplicated(df, ["doc_id"]).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_lines_that_share_half_a_hash_keep_apart(spark, monkeypatch):
    half = L.digests
    monkeypatch.setattr(L, "digests", lambda *a: (half(*a)[0] & np.uint64(3), half(*a)[1]))
    import pyarrow as pa

    rows = [(i, f"shared line {i % 10}\nanother one {i % 7}", None, None) for i in range(40)]
    lines = {}
    for doc, text, *_ in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        own = L.Lines(data, np.array([0, len(data)]), 10)
        h, g = L.digests(own.lowered, own.a, own.b)
        for pair in zip(h.tolist(), g.tolist()):
            lines.setdefault(pair, []).append(doc)
    keys = list(lines)
    table = pa.table({"shard": pa.array([0] * len(keys), pa.int32()), "h": pa.array([k[0] for k in keys], pa.int64()), "g": np.array([k[1] for k in keys], np.uint64).view(np.int64), "owner": [min(v) for v in lines.values()], "n": [len(v) for v in lines.values()]})
    built = L._build(table)
    arrays = L.Arrays(*(built.column(c)[0].as_py() for c in ("hash", "prints", "counts", "owners", "twins")))
    assert len(arrays.twins) >= len(keys) - 4
    for (h, g), docs in lines.items():
        for d in docs:
            assert arrays.dropped(np.array([h], np.uint64), np.array([g], np.uint64), np.array([d]))[0] == (d != min(docs))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.deduplicated(df, ["doc_id"]).collect() == []
    df = spark.createDataFrame([(1, "")], "doc_id long, text string")
    assert [r.n_lines for r in L.deduplicated(df, ["doc_id"]).collect()] == [1]
