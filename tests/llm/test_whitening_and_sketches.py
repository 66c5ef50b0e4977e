"""Embedding whitening against a direct eigendecomposition, and near duplicates by SetSketch registers against all pairs of sets."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from helixframe.llm import minhash_dedup, whitening
from helixframe.llm.setsketch import REGISTERS, evidence_against, registers

VECTORS = "vec_id long, embedding array<float>, label int, x string, n long, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], VECTORS)


def checked(spark, rows):
    """The operator's rows, after comparing them with one machine's exact statistics and eigenvectors."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - s for a, s in zip(x, total)] for x in fit], float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    got = whitening.whiten(table(spark, rows)).collect()
    wanted = min(16, len(total))
    assert len(got) == wanted * len(good)
    by_id = {}
    for i, x in good:
        by_id.setdefault(i, []).append(x)
    for r in got:
        deviations = [sum((n * a - s) ** 2 for a, s in zip(x, total)) for x in by_id[r["vec_id"]]]
        assert r["n"] == n and (r["deviation"] in deviations or (r["deviation"] is None and max(deviations) >= 1 << 63))
        k = r["component"] - 1
        assert r["explained"] == pytest.approx(max(e[k], 0) / e.sum(), rel=1e-9, abs=1e-12)
        if r["whitened"] is not None:
            values = [abs(sum((a - s / n) * c for a, s, c in zip(x, total, u[:, k])) / math.sqrt(e[k])) for x in by_id[r["vec_id"]]]
            assert min(abs(abs(r["whitened"]) - v) for v in values) < 1e-6
            assert r["identity_error"] < 1e-9
    return got


def test_flat_spectrum_is_widened_to_all_dimensions(spark):
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((300, 40)).astype(np.float32))]
    rows += [(1000, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (1001, None), (1002, [None] + rows[0][1][1:]), (1003, [float("nan")] + rows[0][1][1:]), (1004, [float("inf")] + rows[0][1][1:])]
    got = checked(spark, rows)
    assert {r["vec_id"] for r in got} == {None, 1000, *range(300)}


def test_few_vectors_leave_components_undefined(spark):
    r = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((5, 20)).astype(np.float32))]
    got = checked(spark, rows)
    assert {r["component"] for r in got if r["whitened"] is None} == set(range(5, 17))


def test_single_vector_large_entries_and_empty_tables(spark):
    got = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, 0.0, None)] * 4
    checked(spark, [(1, [2.0**40, 1.0]), (2, [2.0**41, -5.0]), (3, [7.0, 2.0**30])])
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(table(spark, rows)).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()


def test_range_finder_stays_narrow_where_the_spectrum_falls():
    r = np.random.default_rng(3)
    u = np.linalg.qr(r.standard_normal((200, 200)))[0]
    e = np.concatenate([np.linspace(10, 5, 16), 1e-3 * np.linspace(1, 0.1, 184)])
    v = (u * e) @ u.T
    got, vectors, said = whitening.principal(lambda q: v @ q, 200, 16)
    assert all(columns == 24 for columns, _ in said) and len(said) < 8
    np.testing.assert_allclose(got, e[:16], rtol=1e-12)
    np.testing.assert_allclose(np.abs((vectors * u[:, :16]).sum(0)), 1, rtol=1e-12)
    flat = np.diag(np.linspace(2, 1, 200))
    got, _, said = whitening.principal(lambda q: flat @ q, 200, 16)
    assert said[-1][0] == 200 and len(said) <= 5
    np.testing.assert_allclose(got, np.linspace(2, 1, 200)[:16], rtol=1e-12)


def fold(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]


def near(spark, rows, percent=85, k=3):
    """The operator's rows, after comparing them with all pairs of sets."""
    sets = []
    for _, t in rows:
        w = fold(t)
        sets.append({tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    want = []
    for j, (i, _) in enumerate(rows):
        ids = [rows[o][0] for o in range(len(rows)) if group[o] == group[j] and rows[o][0] is not None]
        first = min(ids) if ids and sets[j] else i
        want.append((i, len(sets[j]), first, i == first))
    docs = spark.createDataFrame([(i, t, 1, "r", 2, "s") for i, t in rows], "doc_id long, text string, n int, row_key string, comp long, `a.b` string")
    got = [tuple(r) for r in minhash_dedup.near_duplicates(docs, percent=percent, k=k).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_near_duplicates(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    rows = []
    for size, copies in ((6, 12), (20, 25), (110, 40), (700, 6)):
        base = say(size)
        for _ in range(copies):  # some similar enough, some not quite, some linked through others only
            w = list(base)
            for _ in range(r.randint(0, max(2, size // 22))):
                w[r.randrange(size)] = r.choice(vocab)
            base = w if r.random() < 0.2 else base
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, "one two"), (504, "One  two"), (505, "one"), (506, "a b c " * 9), (507, "x " * 60), (508, " ".join(say(20000)))]
    rows += [(None, rows[0][1]), (None, None), (None, "all alone and without an id here"), (3, rows[3][1]), (3, "another text of the same id as before")]
    got = near(spark, rows)
    assert sum(not kept for *_, kept in got) > 20
    assert near(spark, []) == []


def test_similarity_at_the_limit_is_a_link(spark):
    """17 shared of 20 shingles in the union: 0.85 exactly; 16 of 19 is under it."""
    w = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(w[:20])), (2, " ".join(w[:19] + ["v"])), (3, " ".join(w[:21] + ["x"])), (4, "q " + " ".join(w[:20]) + " z")]
    near(spark, rows)


def test_tiles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE", 3)
    monkeypatch.setattr(minhash_dedup, "STAR_BANDS", 1)
    r = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    vary = lambda: " ".join(x if r.random() > 0.035 else f"v{r.randrange(10**9)}" for x in base)
    near(spark, [(i, vary()) for i in range(70)])


def test_registers():
    """Sketches merge by maximum, and equal registers follow the similarity."""
    r = np.random.default_rng(5)
    a, b = (r.integers(0, 1 << 62, n).astype(np.uint64) for n in (900, 100))
    both = np.concatenate([a, b])
    sets = [a, b, both, a[:1], a[:0]]
    got = registers(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    assert (np.maximum(got[0], got[1]) == got[2]).all() and not got[4].any()
    assert abs((got[0] == got[2]).mean() - 0.9) < 0.08
    one = lambda n: np.array([n])
    assert evidence_against(got[:1], got[2:3], one(900), one(1000), 0.85)[0] < 10
    assert evidence_against(got[:1], got[2:3], one(900), one(1100), 0.85)[0] == np.inf
    other = r.integers(0, 1 << 62, 1000).astype(np.uint64)
    apart = registers(np.concatenate([other[:500], a[:500], other[500:], a[:500]]), np.array([0, 1000, 2000]))
    assert evidence_against(apart[:1], apart[1:], one(1000), one(1000), 0.85)[0] > 30 and apart.shape == (2, REGISTERS)
