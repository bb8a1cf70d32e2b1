import random
import re

from strandloom.llm import span_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut(text):
    """[(first byte, words)] of each sentence, by a plain reading of the rules."""
    out, last = [], None
    for m in WORD.finditer(text or ""):
        w = m[0]
        capital = "A" <= w[0] <= "Z" or "À" <= w[0] <= "Þ"
        if last is None or "\n" in text[last.end() : m.start()] or last[0][-1] in ".!?" or (capital and not ("A" <= last[0][0] <= "Z" or "À" <= last[0][0] <= "Þ")):
            out.append((m.start(), []))
        out[-1][1].append(w.lower())
        last = m
    return out


def brute(rows, k, least):
    seen, cover = {}, {}
    for doc, text, *_ in sorted(dict((r[0], r) for r in rows).values(), key=lambda r: (r[0] is None, r[0] or 0)):
        s = cut(text)
        runs = set()
        for i in range(len(s)):
            for way in (1, -1):
                j, n, w = i, 0, 0
                while 0 <= j < len(s) and (n < k or w < least):
                    n, w, j = n + 1, w + len(s[j][1]), j + way
                if n >= k and w >= least:
                    runs.add((min(i, j - way), max(i, j - way) + 1))
        for a, b in sorted(runs):
            h = tuple(x for _, ws in s[a:b] for x in ws)
            if seen.setdefault(h, (doc, a)) != (doc, a):
                cover.setdefault(doc, set()).update(range(a, b))
    out = []
    for doc, text, *_ in rows:
        s = cut(text)
        gone = cover.get(doc, set())
        edges = [p for p, _ in s] + [len(text or "")]
        clean = text if not gone else (text[: edges[0]] + "".join(text[edges[j] : edges[j + 1]] for j in range(len(s)) if j not in gone))
        out.append((doc, clean, len(s), len(gone)))
    return sorted(out, key=repr)


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta the of and river stone".split()) + str(rng.randrange(30)) for _ in range(n)).capitalize() + rng.choice([".", "!", "?", ".\n"])


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    passages = [" ".join(sentence(rng, rng.randint(1, 14)) for _ in range(rng.randint(2, 9))) for _ in range(6)]
    rows = []
    for d in range(80):
        text = " ".join(sentence(rng, rng.randint(1, 12)) for _ in range(rng.randint(0, 8)))
        if d % 2:
            text += " loose words " + rng.choice(passages) + " and on " + sentence(rng, 6)
        if d % 7 == 0:
            text += " " + rng.choice(passages).upper()
        rows.append((rng.randrange(10**6), text, d, "x"))
    rows += [rows[3], (7, None, 0, None), (8, "", 0, None), (None, passages[0], 0, None), (9, "É ça. " * 40, 0, None), (10, " \n x", 0, None), (11, (passages[1] + " ") * 200, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, doc_key string")
    want = brute(rows, S.SENTENCES, S.MIN_WORDS)
    assert sum(r[3] > 0 for r in want) > 15
    for chunk in (10**6, 50):
        monkeypatch.setattr(S, "CHUNK_RUNS", chunk)
        out = S.deduplicated(df, ["doc_id"])
        assert sorted(((r.doc_id, r.clean_text, r.n_sentences, r.n_removed) for r in out.collect()), key=repr) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.deduplicated(df, ["doc_id"]).collect() == []


def lost_share(spark, first, second):
    """The share of words that the second document loses."""
    df = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    clean = {r.doc_id: r.clean_text for r in S.deduplicated(df, ["doc_id"]).collect()}
    assert clean[1]
    return 1 - len(clean[2].split()) / len(second.split())


def words(rng, n):
    return [f"w{rng.randrange(2000)}" for _ in range(n)]


def test_copies_without_sentence_ends(spark):
    long = " ".join(words(random.Random(5), 60))
    assert lost_share(spark, long, long) == 1
    assert lost_share(spark, "same " * 60, "same " * 60) == 1
    assert lost_share(spark, "a b " * 30, "a b " * 30) == 1


def test_recall_of_repeated_windows(spark):
    """Windows of 50 words that an earlier document holds, by brute force, lose most of their words wherever sentences start and end."""
    rng = random.Random(6)
    rows = []
    for i in range(150):
        passage = words(rng, rng.randint(50, 80))
        for at in range(9, len(passage), rng.choice([7, 12, 19, 100])):
            passage[at] += rng.choice(",;:.")
        for d in (2 * i, 2 * i + 1):
            rows.append((d, " ".join([*words(rng, rng.randint(0, 40)), *passage, *words(rng, rng.randint(0, 40))]) + "."))
    seen, windows = set(), []
    for d, text in rows:
        own = text.split()
        grams = [tuple(own[i : i + 50]) for i in range(len(own) - 49)]
        windows += [(d, i, i + 50) for i, g in enumerate(grams) if g in seen]
        seen.update(grams)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.clean_text for r in S.deduplicated(df, ["doc_id"]).collect()}
    texts = dict(rows)
    docs = {d for d, _, _ in windows}
    assert len(docs) >= 145
    whole, lost = 0, []
    for d in docs:
        spread = {i for e, a, b in windows if e == d for i in range(a, b)}
        gone = len(texts[d].split()) - len(clean[d].split())
        lost.append(gone / len(spread))
        assert gone <= len(spread)
    assert min(lost) > 0 and sum(x < 0.5 for x in lost) <= len(lost) / 20
    assert sum(lost) / len(lost) > 0.75


def test_rows_that_share_an_id_keep_their_own_sentences(spark):
    rng = random.Random(7)
    text = lambda n: " ".join(" ".join(words(rng, 11)).capitalize() + "." for _ in range(n))
    passage, own, both = text(3), [text(4) for _ in range(6)], text(3)
    rows = [(1, f"{passage} {own[0]}"), (5, f"{passage} {own[1]}"), (5, own[2]), (None, f"{passage} {own[3]}"), (None, own[4]), (None, f"{own[5]} {both}"), (None, both), (None, both)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.clean_text.strip()) for r in S.deduplicated(df, ["doc_id"]).collect()), key=repr)
    want = [(1, rows[0][1]), (5, own[1]), (5, own[2]), (None, own[3]), (None, own[4]), (None, f"{own[5]} {both}"), (None, ""), (None, "")]
    assert out == sorted(want, key=repr)


def test_copies_of_one_document_lose_the_same(spark):
    rng = random.Random(8)
    passage = " ".join(" ".join(words(rng, 11)).capitalize() + "." for _ in range(3))
    df = spark.createDataFrame([(1, passage), (2, passage + " End."), (2, passage + " End.")], "doc_id long, text string").repartition(3)
    assert sorted(r.clean_text for r in S.deduplicated(df, ["doc_id"]).collect()) == sorted(["End.", "End.", passage])


def test_more_shards_change_nothing(spark, monkeypatch):
    passage = " ".join(f"word{i} goes here and there." for i in range(12))
    docs = spark.createDataFrame([(i, f"Document {i} begins {i * 7} times. {passage} It ends with {i * 3} lines.") for i in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    got = []
    for size in (S.SHARD_BYTES, 50):
        monkeypatch.setattr(S, "SHARD_BYTES", size)
        got.append(sorted(map(tuple, S.deduplicated(docs, ["doc_id"]).collect()), key=lambda r: r[0]))
    assert got[0] == got[1] and sum(r[2] > 0 for r in got[0]) == 39
