"""Whitening: exact parts against fractions, components against numpy, and odd vectors."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from spanwise.llm import whitening as q


def by_fractions(a):
    """det(x - a) by the method of Faddeev and LeVerrier."""
    n, a = len(a), [[Fraction(x) for x in row] for row in a]
    c, m = [Fraction(1)], [[Fraction(0)] * n for _ in range(n)]
    for k in range(1, n + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(n)) + (c[-1] if i == j else 0) for j in range(n)] for i in range(n)]
        am = [[sum(a[i][t] * m[t][j] for t in range(n)) for j in range(n)] for i in range(n)]
        c.append(-sum(am[i][i] for i in range(n)) / k)
    return [int(x) for x in reversed(c)]


def gram(rows):
    return [[sum(r[i] * r[j] for r in rows) for j in range(len(rows[0]))] for i in range(len(rows[0]))]


def test_characteristic_polynomial(spark):
    r = random.Random(3)
    for n, size, rank in ((1, 5, 3), (2, 10**9, 2), (5, 10**12, 3), (7, 3, 9), (6, 1, 2)):
        a = gram([[r.randrange(-size, size + 1) for _ in range(n)] for _ in range(rank)])
        assert q.characteristic(spark, a) == by_fractions(a)
    # a zero below the diagonal, which reduction has to pass by
    a = [[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 2, 0], [1, 0, 0, 2]]
    assert q.characteristic(spark, a) == by_fractions(a)


def poly_of(roots):
    p = [1]
    for x in roots:
        p = [(p[k - 1] if k else 0) - x * (p[k] if k < len(p) else 0) for k in range(len(p) + 1)]
    return p


@pytest.mark.parametrize("roots", [[0, 0, 3], [5], [7, 7, 7, 7], [1, 10**12, 10**12 + 1, 10**12 + 1, 2, 2], list(range(1, 20))])
def test_roots_are_isolated_and_refined(roots):
    p = q.RealRoots(poly_of(roots))
    assert q.distinct_roots(p.poly) == len(set(roots))
    for x in sorted({*roots, 1, 4}):
        assert p.above(Fraction(x)) == sum(y > x for y in roots) and p.above(x - Fraction(1, 3)) == sum(y >= x for y in roots)
    parts = p.isolated(len(set(roots)), Fraction(1 << 41), len(roots))
    assert [m for *_, m in parts] == [roots.count(x) for x in sorted(set(roots), reverse=True)]
    for (low, high, _), x in zip(parts, sorted(set(roots), reverse=True), strict=True):
        assert abs(p.refined(low, high, 100) - x) <= (high - low) / 2**100


def test_eigenvectors_of_close_and_equal_values(spark):
    a = [[4, 1, 0, 0], [1, 4, 0, 0], [0, 0, 5, 0], [0, 0, 0, 10**12]]  # 10^12, 5 twice, 3
    found = q.eigen(spark, a, 4)
    assert [round(float(e), 9) for e, _ in found] == [1e12, 5, 5, 3]
    v = np.array([v for _, v in found])
    assert np.abs(v @ v.T - np.eye(4)).max() < 1e-15
    assert max(np.abs(np.array(a, float)[:3, :3] @ x[:3] - float(e) * x[:3]).max() for (e, _), x in zip(found[1:], v[1:], strict=True)) < 1e-14
    close = [[10**15, 1], [1, 10**15]]  # eigenvalues a part in 10^15 apart
    (_, x), (_, y) = q.eigen(spark, close, 2)
    assert abs(abs(x[0]) - math.sqrt(0.5)) < 1e-15 and abs(x[0] - x[1]) < 1e-15 and abs(y[0] + y[1]) < 1e-15


def check(df, vectors, components):
    """vectors: those whole, by id; the result must be what numpy's eigenvectors give, up to sign."""
    x = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in vectors}
    listed = sorted(set(map(tuple, x.values())))
    n, sums = len(listed), [sum(c) for c in zip(*listed, strict=True)]
    cov = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in listed), n**3)) for j in range(len(sums))] for i in range(len(sums))])
    e = np.linalg.eigvalsh(cov)[::-1]
    want = min(components, int((e > 1e-9 * e[0]).sum()))
    got = q.whiten(df, components=components).collect()
    assert len(got) == len(vectors) * want
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums, strict=True))
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9
    # the lengths of whitened vectors do not depend on signs, nor on the choice among equal eigenvalues if all are returned
    if want == len(sums):
        inverse = np.linalg.inv(cov)
        for k, v in x.items():
            d = np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)])
            assert abs(sum(r.whitened**2 for r in got if r.vec_id == k) / list(dict(vectors)).count(k) - d @ inverse @ d * sum(i == k for i, _ in vectors)) < 1e-6
    return got


def test_against_numpy(spark):
    r = random.Random(1)
    rows = [(k, [r.gauss(0, 1) * s + 100 for s in (1, 1, 3, 0.5, 20)]) for k in range(200)]
    rows += [(k + 1000, v) for k, v in rows[:20]]  # equal vectors count once
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    check(df, rows, 16)
    check(df, rows, 2)


def test_equal_eigenvalues_and_missing_ranks(spark):
    rows = [(k, [float(s * (i == j)) for j in range(4)] + [2.0, 0.0]) for k, (i, s) in enumerate((i, s) for i in range(4) for s in (-1, 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = check(df, rows, 16)
    assert {r.component for r in got} == {1, 2, 3, 4} and {round(r.explained, 12) for r in got} == {0.25}


def test_odd_rows(spark):
    good = [(1, [0.5, 1.0]), (2, [-0.25, 3.0]), (2, [-0.25, 3.0]), (None, [7.5, -1.0]), (3, [1e12, 4.0])]
    bad = [(4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0]), (10, [1.0, 2.0, 3.0]), (11, [1e300, 0.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "'a' AS component", "2 AS row")
    got = q.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((k or 0, c) for k, _ in good for c in (1, 2))
    assert {r.n for r in got} == {4} and all(r.identity_error < 1e-9 for r in got)
    # 4 * (x - mean) of the large entry is about 2 * 10^14, its square passes a long
    assert all(r.deviation is None for r in got)
    assert q.whiten(df.limit(0)).count() == 0 and q.whiten(df.where("vec_id = 2")).count() == 0 and q.whiten(df.where("vec_id > 3")).count() == 0
    assert q.whiten(df.limit(0)).columns == q.whiten(df).columns


def test_products_are_exact():
    r = random.Random(2)
    for size in (10, 1 << 19, 1 << 30, 1 << 61):
        d = [[r.randrange(-size, size) for _ in range(3)] for _ in range(50)]
        assert q._products(np.array(d, np.int64)).tolist() == gram(d)
