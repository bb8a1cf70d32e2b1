import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from strandloom.llm import filter_audit as A

DOCS, LABELS = "doc_id long, text string, lang string, mask int, part string", "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """The audit by walking every document through every order."""
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    counts, parts = defaultdict(Counter), {lang or "" for _, _, lang, *_ in docs}
    for i, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first.get(text, i) < i}
        for order in permutations("ABCDE"):
            alive = True
            for step, f in enumerate(order, 1):
                own = counts[lang or "", "".join(order), step]
                if fails[f]:
                    own["removed" if alive else "redundant"] += 1
                    own["unique"] += sum(fails.values()) == 1
                    own["good"] += alive and i in good
                    own["toxic"] += alive and i in toxic
                    alive = False
                own["kept"] += alive
    shares = Counter()
    for (part, order, step), own in counts.items():
        shares[part, order[step - 1]] += own["removed"]
    return sorted((p, "".join(o), s, *(counts[p, "".join(o), s][k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")), shares[p, o[s - 1]]) for p in parts for o in permutations("ABCDE") for s in range(1, 6))


def got(spark, docs, labels):
    rows = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS)
    out = A.audit(A.masked(rows, spark.createDataFrame(labels, LABELS)))
    assert out.columns == ["part", "filter_order", "step", *A.COUNTS, "shapley"]
    return sorted(tuple(r) for r in out.collect())


def test_matches_a_walk_of_every_document(spark, monkeypatch):
    monkeypatch.setattr("strandloom.operators.joins.HOT_ROWS", 20)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)] + ["Éa", "x\xa0y"]
    docs = [(None, None, None), (None, "same", "en"), (1, None, "en"), (2, "", ""), (3, " \t\n", None), (4, "x " * 50000, "de"), (4, "x " * 50000, "de")]
    for i in range(5, 160):
        text = rng.choice(["\n", " ", "\x0b"]).join(rng.choices(words[: rng.choice((5, 60, 402))], k=rng.choice((99, 100, 101, 130))))
        text = text.upper() if rng.random() < 0.1 else text
        text += rng.choice(["", "", "", " #", " a&b", " |", "."])
        docs.append((i, rng.choice([text, text, "same " * 100, "same"]), rng.choice(["en", "de", None, "a'b"])))
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 160, 2)] + [(6, 1, 0), (None, 1, 1), (7, None, 1), (999, 1, 1)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_one_part_of_zeros_and_empty_tables(spark):
    clean = " ".join(f"w{i}" for i in range(120))
    rows = got(spark, [(1, clean, "en")], [])
    assert len(rows) == 600 and all(r[3:] == (1, 0, 0, 0, 0, 0, 0) for r in rows)
    assert got(spark, [], [(1, 1, 1)]) == []
