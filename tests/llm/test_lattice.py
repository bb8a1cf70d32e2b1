import numpy as np
import pytest
from strandloom.llm import lattice as L

SCHEMA = "vec_id long, v array<double>, U string, ball int"


def brute(rows, least=0.9):
    """{row number: (links, component)} by all pairs."""
    fit = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(rows[i][1]) for i in fit}
    links = {i: set() for i in range(len(rows))}
    for n, i in enumerate(fit):
        for j in fit[:n]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i].add(j)
                links[j].add(i)
    low = list(range(len(rows)))
    for _ in rows:
        low = [min([low[i], *(low[j] for j in links[i])]) for i in range(len(rows))]
    ids = {c: min((rows[i][0] for i in range(len(rows)) if low[i] == c and rows[i][0] is not None), default=None) for c in set(low)}
    return [(rows[i][0], len(links[i]), ids[low[i]]) for i in range(len(rows))]


def vectors(rng, d=16):
    """Tight groups, loose groups, chains, and scattered directions."""
    out = list(rng.normal(size=(150, d)))
    for size, noise in ((60, 0.02), (40, 0.08), (30, 0.16), (25, 0.25), (20, 0.35)):
        base = rng.normal(size=d)
        out += list(base + noise * np.linalg.norm(base) / d**0.5 * rng.normal(size=(size, d)))
    step = rng.normal(size=(2, d))
    out += [np.cos(a) * step[0] + np.sin(a) * step[1] for a in np.linspace(0, 3, 25)]
    return [list(map(float, v)) for v in out]


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], SCHEMA)
    out = L.linked(df, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return [tuple(r) for r in out.collect()]


def test_decoded_is_the_nearest_lattice_point():
    rng = np.random.default_rng(1)
    assert len(L.ROOTS) == 240 and {float((r * r).sum()) for r in L.ROOTS} == {2.0}
    x = rng.normal(size=(500, 8)) * 3
    own = L.decoded(x)
    twice = np.rint(2 * own)
    assert (twice == 2 * own).all() and (own.sum(1) % 2 == 0).all() and all(len(set(row % 2)) == 1 for row in twice)
    gap = ((x - own) ** 2).sum(1)
    assert (gap <= 1 + 1e-9).all()  # the covering radius of E8 is 1
    assert all((gap <= ((x - own - r) ** 2).sum(1) + 1e-12).all() for r in L.ROOTS)
    near = L.asked(x, own, 6)
    far = ((x[:, None] - near) ** 2).sum(2).max(1)
    assert all((np.sort(((x - own)[:, None] - L.ROOTS) ** 2 @ np.ones(8), 1)[:, 5] >= far - 1e-9).tolist())


def test_links_and_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ROWS", 16)
    monkeypatch.setattr("strandloom.operators.joins.HOT_ROWS", 20)
    rows = [(i, v) for i, v in enumerate(vectors(np.random.default_rng(4)))]
    mine, true = sorted(got(spark, rows, recall=0.9999)), sorted(brute(rows))
    assert [(i, n, c) for i, n, c, _ in mine] == true
    assert all(kept == (i == c) for i, _, c, kept in mine)
    assert max(n for _, n, _ in true) >= 59


def test_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [(5, a), (5, a), (None, a), (7, [2 * x for x in a]), (8, None), (9, []), (10, [0.0, 0.0, 0.0]), (11, [1.0, None, 2.0]), (12, [float("nan"), 1.0, 1.0]), (13, [float("inf"), 1.0, 1.0]), (14, b), (15, [*a, 0.0]), (None, None), (16, [1e300, 2e300, 3e300]), (17, [1e-300, 2e-300, 3e-300])]
    mine = sorted(got(spark, rows), key=repr)
    own = {5: (5, 5), 7: (5, 5), 16: (5, 5), 17: (5, 5)}
    want = [(i, *own.get(i, (0, i)), own.get(i, (0, i))[1] == i) for i, _ in rows]
    want[2], want[12] = (None, 5, 5, False), (None, 0, None, True)
    assert mine == sorted(want, key=repr)
    assert got(spark, []) == []


@pytest.mark.parametrize("least,found", [(0.9, 0.97), (0.95, 0.995)])
def test_recall_of_pairs_at_the_threshold(spark, least, found):
    rng = np.random.default_rng(8)
    a, z = rng.normal(size=(2, 600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = least * a + (1 - least**2) ** 0.5 * z + 1e-9 * a
    rows = [(i, list(v)) for i, v in enumerate([*a, *b])]
    mine = {i: n for i, n, *_ in got(spark, rows)}
    assert sum(mine[i] for i in range(600)) >= found * 600
