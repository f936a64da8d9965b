"""Whitening against numpy and exact integers; the pivot index against all pairs."""

from fractions import Fraction

import numpy as np
import pytest

from chatloom.llm import charpoly, pivots, whitening


# ---- exact arithmetic -----------------------------------------------------------
def test_characteristic_polynomial():
    rng = np.random.default_rng(0)
    for d in (1, 2, 5, 9):
        a = rng.integers(-50, 50, (d, d))
        a = a @ a.T if d > 1 else abs(a)
        a[:, 0] = a[0, :] = 0 if d == 5 else a[:, 0]  # a zero column needs a pivot elsewhere
        primes = charpoly.primes_needed(d, int(np.trace(a)))
        poly = charpoly.from_residues(primes, [charpoly.charpoly_mod(a.tolist(), p).tolist() for p in primes])
        assert poly[d] == 1 and poly[d - 1] == -int(np.trace(a))
        assert np.allclose(np.array(poly[::-1], float), np.poly(a.astype(float)), rtol=1e-6, atol=1e-3 * max(map(abs, poly)))


@pytest.mark.parametrize("roots", [[7, 5, 5, 5, 3, 0, 0], [1], [0, 0], [4, 4], [10**9, 10**9 - 1, 1], [6, 3, 2, 1, 1]])
def test_roots_with_their_number(roots):
    poly = [1]
    for r in roots:
        poly = [b - r * a for a, b in zip([*poly, 0], [0, *poly], strict=True)]
    found = []
    for a, b, k, n in charpoly.isolate(poly, 32):
        if n == 1:
            a, b, k = charpoly.refine(poly, a, b, k)
        found += [round(float(Fraction(a + b, 2 ** (k + 1))), 6)] * n
    assert found == sorted((float(r) for r in roots if r), reverse=True)


def test_exact_products_of_large_entries():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**62), 2**62, (50, 3))
    want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(3)] for i in range(3)]
    assert whitening.exact_products(x).tolist() == want
    assert sum(d << (56 * k) for k, d in enumerate(whitening._digits(-(3**90)))) == -(3**90)


# ---- whitening ------------------------------------------------------------------
def vectors_frame(spark, rows):
    return spark.createDataFrame(
        [(i, v, "x", 0, 1.0) for i, v in rows], "vec_id long, embedding array<double>, row string, component int, whitened double").repartition(3)


def test_whiten_against_numpy(spark):
    rng = np.random.default_rng(2)
    good = (rng.standard_normal((300, 6)) * [3, 2, 1, 1, 0.5, 0.01] @ rng.standard_normal((6, 6))).tolist()
    rows = list(enumerate(good)) + [(5, good[5]), (None, good[6])]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0, 2.0]), (905, [])]
    out = whitening.whiten(vectors_frame(spark, rows + bad), components=4).toPandas()
    x = np.floor(64 * np.array([v for _, v in rows])).astype(int) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    assert len(out) == 4 * n and set(out["n"]) == {n}
    away = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, total, strict=True)) for r in x]
    assert sorted(out[out.component == 1].deviation.tolist()) == sorted(away)
    values, axes = np.linalg.eigh(np.cov((x - total / n).T, bias=True))
    for c in range(1, 5):
        e, v = values[-c], axes[:, -c]
        want = (x - total / n) @ v / np.sqrt(e)
        got = out[out.component == c]
        assert np.allclose(got.explained, e / values.sum(), rtol=1e-9)
        assert np.allclose(np.sort(np.abs(got.whitened)), np.sort(np.abs(want)), atol=1e-6)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    assert out.vec_id.isna().sum() == 4


def test_whiten_equal_variances_and_none(spark):
    square = [(i, [float(a), float(b), 0.0]) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    out = whitening.whiten(vectors_frame(spark, square)).toPandas()
    assert sorted(set(out.component)) == [1, 2]  # the third has no variance
    assert np.allclose(out.explained, 0.5) and out.identity_error[0] < 1e-12
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        frame = vectors_frame(spark, rows)
        out = whitening.whiten(frame)
        assert out.count() == 0
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whiten_deviation_beyond_a_long_is_null(spark):
    out = whitening.whiten(vectors_frame(spark, [(1, [1e12, 0.0]), (2, [-1e12, 0.5]), (3, [0.0, 1.0])])).toPandas()
    assert out[out.vec_id == 1].deviation.isna().all()
    assert out.identity_error[0] < 1e-9


# ---- pivots ---------------------------------------------------------------------
def all_pairs(rows, least):
    """Links and smallest reachable id, the plain way."""
    usable = [i for i, (_, v, g) in enumerate(rows) if v and g is not None and len(v) == 12 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(rows)
    for i in usable:
        for j in usable:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i < j and rows[i][2] == rows[j][2] and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    smallest = {}
    for i, (k, _, _) in enumerate(rows):
        at = find(i)
        smallest[at] = min((x for x in (smallest.get(at), k) if x is not None), default=None)
    return sorted(((k, links[i], smallest[find(i)], k == smallest[find(i)]) for i, (k, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("most", [2048, 7])
def test_links_against_all_pairs(spark, most):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(12).tolist(), int(i % 3)) for i in range(150)]
    for c in range(3):  # near copies, a chain, exact and scaled copies
        centre = rng.standard_normal(12)
        rows += [(1000 + 100 * c + i, (centre + 0.05 * rng.standard_normal(12)).tolist(), c) for i in range(25)]
        step = rng.standard_normal(12)
        rows += [(2000 + 100 * c + i, (centre + 0.25 * i * step).tolist(), c) for i in range(8)]
        rows += [(3000 + 100 * c + i, (centre * (1 + i % 2)).tolist(), c) for i in range(6)]
    copy = rows[160]
    rows += [copy, (1, copy[1], copy[2]), (None, copy[1], copy[2]), (7000, copy[1], None), (7001, copy[1], copy[2] + 40)]
    rows += [(8000, None, 0), (8001, [], 0), (8002, [0.0] * 12, 0), (8003, [None] * 12, 0), (8004, [float("nan")] * 12, 0), (8005, [1.0], 0), (None, None, 0)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, node string, n_links int, vector int").repartition(3)
    got = pivots.near_duplicate_vectors(frame, most=most).collect()
    want = all_pairs(rows, 0.93)
    kept = lambda k, c: k == c
    assert sorted(((r.vec_id, r.n_links, r.component_id, kept(r.vec_id, r.component_id)) for r in got), key=str) == want
    assert all(r.kept == kept(r.vec_id, r.component_id) for r in got)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows, want in (([], []), ([(3, [1.0, 0.0], 1)], [(3, 0, 3)]), ([(3, [1.0, 0.0], 1), (2, [0.99, 0.01], 1)], [(2, 1, 2), (3, 1, 2)])):
        got = pivots.near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want


def test_recall_over_random_directions():
    """The share of pairs at the threshold that share enough pivots (the only loss of the index)."""
    rng = np.random.default_rng(4)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    points = unit(rng.standard_normal((4096, 64)))
    chosen = pivots.choose_pivots(points)
    x = unit(rng.standard_normal((3000, 64)))
    away = rng.standard_normal((3000, 64))
    away = unit(away - (away * x).sum(axis=1)[:, None] * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * away
    shared = [len(set(a) & set(b)) for a, b in zip(pivots.nearest_pivots(x, chosen).tolist(), pivots.nearest_pivots(y, chosen).tolist(), strict=True)]
    assert np.mean(np.array(shared) >= pivots.SHARED) > 0.97
