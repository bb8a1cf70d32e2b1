import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from strandloom.llm import token_codec as K
from strandloom.llm import tokens as T

THUE = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(2048)) for k in (0, 1)]
TEXTS = [*THUE, "a,b.c!d'e,'s x,'re (foo)bar #tag a\nb\n\nc\td \te", "nul\x00 nul\x00\x00 nul", None, "", " ", "  x", "Hello, world! it's 3.14\n\n  done  ", "a\x1cb\x1d c", "x\xa0 y z  ", "日本語 テスト　空白", "<|endoftext|> x<|endoftext|>", "é" * 3000, "tail \n", "word " * 30000, "I'll we've\tthey'd\r\n\x0b\x0cok", "😀 emoji 👩‍👩‍👧", "“quoted” – text…"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(T.vocabulary_path())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def encode_all(texts):
    import pyarrow as pa
    from strandloom.llm.common import slices

    out = []
    for _, _, data, offsets in slices(pa.array(texts, pa.string()), 200):
        ids, sizes = T.encode_slice(T.encoder(T.vocabulary_path()), data, offsets, 2)
        out += [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    return out


def test_pieces_give_the_library_ids(reference):
    assert encode_all(TEXTS) == [reference(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\x0b\xa0　\x1e\x00ab'sZé日1.!,(😀"), max_size=40), min_size=1, max_size=5))
def test_any_text_gives_the_library_ids(reference, texts):
    assert encode_all(texts) == [reference(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 70_000, 600_001])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 50_256)
    counts = np.bincount(ids, minlength=1)
    counts[-1] += 1
    table = K.FrequencyTable(counts)
    assert table.freq.sum() == 1 << K.PROBABILITY_BITS
    payload = K.encode(ids, table)
    assert np.array_equal(K.decode(payload, table), ids)
    if n > 100_000:
        parts = K._parts(payload)
        entropy = -(counts[counts > 0] / counts.sum() * np.log2(counts[counts > 0] / counts.sum())).sum()
        assert len(parts[3]) > 1 and len(payload) * 8 / n < entropy * 1.1
        second = K.decode_part(parts, table, 1)
        at = int(parts[3][1][0]) * parts[1]
        assert np.array_equal(second, ids[at : at + len(second)])
        for spot in (40, len(payload) // 2, len(payload) - 1):
            bad = bytearray(payload)
            bad[spot] ^= 1
            with pytest.raises(ValueError):
                K.decode(bytes(bad), table)


def test_a_full_cache_forgets_and_stays_right(reference):
    own = T.PieceEncoder(T.vocabulary_path(), most=20)
    words = [f"word{'x' * (i % 23)}{i % 61}, Ärger{i % 7}" for i in range(300)]
    for lo in range(0, 300, 10):
        text = " ".join(words[lo : lo + 10])
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = T.encode_slice(own, data, np.array([0, len(data)]), 2)
        assert ids.tolist() == reference(text)
    assert own.n < 120


def test_archive(spark, tmp_path, reference):
    rows = [(100 - i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", None), (95, "twice", None), (95, "again", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = f"file://{tmp_path}/a"
    T.written(df, path, block_ids=500)
    got = sorted(T.read(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in want]
    start = 0
    for r, (_, text, _) in zip(got, want):
        ids = reference(text)
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_table(spark):
    assert T.encoded(spark.createDataFrame([], "doc_id long, text string")).collect() == []
