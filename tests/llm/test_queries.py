"""Every registered query over small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import zlib

import pytest
from strandloom.llm.queries import QUERIES

from .test_line_dedup import brute as brute_lines
from .test_quality_rules import brute as brute_stats
from .test_simhash import brute_classes, brute_print

#: Two lines of one length that a polynomial modulo a power of two takes for equal.
THUE = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(2048)) for k in (0, 1)]
PROSE = [" ".join(f"word{(i * 7 + j * j) % 97} falls under the old tree" for j in range(12)) for i in range(30)]
TEXTS = {i: t for i, t in enumerate(PROSE)} | {
    100: None, 101: "", 102: " \t\n ", 103: "\n".join(THUE), 104: THUE[0], 105: THUE[1], 106: "a long word " * 20_000, 107: PROSE[3], 108: PROSE[3], 109: PROSE[4] + "\nthe same line twice\nThe same line TWICE  ", 110: "ü" * 5000, 111: "x\x00y \xa0z",
}
DOCS = [(i, t, ["en", "de", None][i % 3], ["web", "books", None][i % 3], len(t or ""), "own", 1) for i, t in TEXTS.items()]
DOC_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, row_number int"
PAGE = "<html><body><nav><a href=x>menu</a></nav><article><h1>Head {0}</h1><p>Some words of page {0}.</p></article></body></html>"
PAGES = [(i, f"http://a/{i}", PAGE.format(i % 20), "own") for i in range(40)] + [(100, None, None, None), (101, "u", "", None), (102, "u", "<p " * 5000, None), (103, "v", PAGE.format(1), None)]
ITEMS = [(1, PROSE[2]), (2, None), (3, "no such words anywhere in the texts above"), (4, PROSE[2])]
LABELS = [(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (5, None, 0), (999, 1, 1)]


def write(spark, folder, docs, pages, items, labels):
    for name, rows, schema in (("documents", docs, DOC_COLUMNS), ("pages", pages, "page_id long, url string, html string, digest string"), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("full"), DOCS, PAGES, ITEMS, LABELS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


def run(spark, folder, number):
    (name,) = (n for n in QUERIES if n.startswith(f"op{number}_"))
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("number", range(1, 11))
def test_empty_tables(spark, empty, number):
    assert run(spark, empty, number) == []


def test_op1(spark, full):
    got = {r.doc_id: r for r in run(spark, full, 1)}
    assert set(got) == set(TEXTS)
    for i, t in TEXTS.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(t)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
    assert got[103].n_dup_lines == 0 and got[3].kept == got[107].kept == got[108].kept


def test_op2(spark, full):
    got = {r.doc_id: r for r in run(spark, full, 2)}
    assert set(got) == set(TEXTS) and got[100].text is None and got[101].text == ""
    assert got[107].n_removed == got[107].n_sentences > 0 == got[3].n_removed and not got[108].text.strip()


def test_op3(spark, full):
    found = {(r.doc_id, r.item_id) for r in run(spark, full, 3)}
    assert {(2, 1), (2, 4)} <= found and not any(item in (2, 3) for _, item in found)


def test_op4(spark, full):
    got = {r.doc_id: r for r in run(spark, full, 4)}
    assert set(got) == set(TEXTS)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert got[100].score == got[101].score and got[3].score == got[107].score


def test_op5(spark, full):
    from strandloom.llm.tokens import vocabulary_path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    start = 0
    for r in sorted(run(spark, full, 5), key=lambda r: r.doc_id):
        ids = [*t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)


def test_op6(spark, full):
    got = sorted((tuple(r) for r in run(spark, full, 6)), key=repr)
    assert got == sorted((r[:4] for r in brute_lines(DOCS)), key=repr)
    assert {r[0]: r[2] for r in got}[105] == 1 and {r[0]: r[2] for r in got}[103] == 0


def test_op7(spark, full):
    got = {r.page_id: r for r in run(spark, full, 7)}
    assert set(got) == {p[0] for p in PAGES} and all(r.n_chars == len(r.text) for r in got.values())
    assert got[100].text == got[101].text == "" and sum(got[i].text == f"Head {i % 20}\nSome words of page {i % 20}." for i in range(40)) >= 38


def test_op8(spark, full):
    want = set()
    for page, _, html, _ in PAGES:
        body = (html or "").encode()
        owner = max(p[0] for p in PAGES if (p[2] or "") == (html or ""))
        want.add((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if page == owner else "revisit", None if page == owner else owner))
    assert {tuple(r) for r in run(spark, full, 8)} == want


def test_op9(spark, full):
    got = {r.doc_id: r for r in run(spark, full, 9)}
    assert {i: r.size for i, r in got.items()} == {i: brute_stats(t)[0] for i, t in TEXTS.items()}
    assert all(r.taken <= 3 * r.size for r in got.values())
    assert {i: r.taken for i, r in got.items()} == {r.doc_id: r.taken for r in run(spark, full, 9)}


def test_op10(spark, full):
    got = {r.doc_id: r for r in run(spark, full, 10)}
    prints = {i: brute_print(t) for i, t in TEXTS.items()}
    signed = {p: p - 2**64 if p >= 2**63 else p for p in prints.values()}
    classes = brute_classes(set(signed.values()))
    lowest = {}
    for i, p in prints.items():
        c = classes[signed[p]]
        lowest[c] = min(lowest.get(c, i), i)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", lowest[classes[signed[p]]]) for i, p in prints.items()}
