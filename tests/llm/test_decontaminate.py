import re

from strandloom.llm import decontaminate as D


def grams(text):
    w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items, by_text=False):
    out = set()
    for d, t, *_ in docs:
        for i, q, *_ in items:
            a, b = grams(q), grams(t)
            if a and 100 * len(a & b) >= 80 * len(a):
                out.add((d, i, len(a), len(a & b)) if not by_text else (d, t))
    return sorted(out, key=repr)


def text(start, n):
    return " ".join(f"w{(start * 31 + i * i + i) % 997}" for i in range(n))


ITEMS = [(i, text(i, n), "x") for i, n in enumerate([5, 6, 9, 20, 36, 70, 150, 400, 4])] + [(50, None, None), (51, "", None), (None, text(77, 30), None), (3, text(3, 20), "x")]
LONG = text(500, 30_000)


def corpus():
    rows = [(100, LONG, 1, 1), (101, None, None, None), (102, "", 1, 1)]
    for i, q, *_ in ITEMS:
        w = (q or "").split()
        rows.append((1000 + (i or 90), LONG[:5000] + " " + " ".join(w).upper().replace(" ", ",  ") + " " + LONG[5000:9000], 1, 1))
        rows.append((2000 + (i or 90), " ".join(x if j % 23 else "changed" for j, x in enumerate(w)), 1, 1))
        rows.append((3000 + (i or 90), " ".join(x if j % 9 else "changed" for j, x in enumerate(w)), 1, 1))
        rows.append((4000 + (i or 90), " ".join(w[: int(len(w) * 0.86)]), 1, 1))
    return [*rows, rows[7], (None, rows[9][1], 1, 1)]


def frames(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, leak_doc int, doc_hash int"), spark.createDataFrame(ITEMS, "item_id long, text string, doc_id string")


def test_contained_items(spark, monkeypatch):
    docs, items = frames(spark, corpus())
    want = brute(corpus(), ITEMS)
    pick = lambda: sorted({(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in D.contained(docs.select("doc_id", "text"), items).collect()}, key=repr)
    assert len(want) > 15 and pick() == want
    monkeypatch.setattr(D, "MOST_BROADCAST_ROWS", 0)
    assert pick() == want


def test_documents_without_items_stay(spark):
    docs, items = frames(spark, corpus())
    out = D.decontaminated(docs, items)
    leaks = brute(corpus(), ITEMS, by_text=True)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted((d for d, t, *_ in corpus() if (d, t) not in leaks), key=repr)


def test_empty(spark):
    docs, items = frames(spark, corpus()[:2])
    assert D.contained(docs.select("doc_id", "text").limit(0), items).collect() == []
    assert D.decontaminated(docs, items.limit(0)).count() == 2
