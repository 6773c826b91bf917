import math

import numpy as np
import pytest

from proofmill.llm.whitening import (
    common_divisor,
    exact_products,
    null_vectors,
    polynomials_modulo,
    primes_below,
    primes_for,
    principal_roots,
    remaindered,
    roots_above,
    square_free_parts,
    whitened_components,
)


def product(*factors):
    out = [1]
    for f in factors:
        new = [0] * (len(out) + len(f) - 1)
        for i, a in enumerate(out):
            for j, b in enumerate(f):
                new[i + j] += a * b
        out = new
    return out


def exact_polynomial(matrix):
    """Coefficients by Faddeev and LeVerrier's recursion in whole numbers."""
    d = len(matrix)
    out, m, one = [1], np.zeros((d, d), object), np.eye(d, dtype=int).astype(object)
    for k in range(1, d + 1):
        m = matrix.dot(m) + out[-1] * one
        out.append(-int(np.trace(matrix.dot(m))) // k)
    return out[::-1]


def test_polynomial_is_exact():
    r = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 2), (5, 3), (9, 9), (12, 4)):
        x = r.integers(-999, 999, (rank, d))
        m = (x.T @ x).astype(object)
        primes = primes_for(m)
        poly = remaindered(polynomials_modulo(m, primes)[:-1].astype(object), primes[:-1])
        assert poly == exact_polynomial(m)
        values = [a / 2**b for a, b, n in principal_roots(poly, int(np.trace(m)), d) for _ in range(n)]
        assert np.allclose(values, np.sort(np.linalg.eigvalsh(m.astype(float)))[::-1][:rank], rtol=1e-9)
        assert len(values) == rank


def test_a_pivot_that_vanishes():
    m = np.array([[2, 0, 1, 0], [0, 3, 0, 0], [1, 0, 2, 0], [0, 0, 0, 0]], object)
    assert polynomials_modulo(m, [101]).tolist() == [[c % 101 for c in exact_polynomial(m)]]


def test_repeated_roots_and_their_space():
    poly = product([-5, 1], [-5, 1], [-5, 1], [-3, 1], [-3, 1], [-7, 1])
    assert sorted((tuple(p), n) for p, n in square_free_parts(poly)) == [((-7, 1), 1), ((-5, 1), 3), ((-3, 1), 2)]
    assert common_divisor(poly, [0, 0, 9]) == [1]
    assert [(a / 2**b, n) for a, b, n in principal_roots([0, 0, *poly], 50, 4)] == [(7.0, 1), (5.0, 3)]
    assert [roots_above(poly, 2 * x + 1, 1) for x in (2, 3, 4, 5, 6, 7)] == [6, 4, 4, 1, 1, 0]
    turn = np.array([[1, 2, 2], [2, 1, -2], [2, -2, 1]], object)  # three times a rotation
    m = turn.T.dot(np.diag([4, 4, 9]).astype(object)).dot(turn)
    v = null_vectors(m, 36, 0, 2)
    assert np.allclose(v @ v.T, np.eye(2), atol=1e-14) and np.allclose(v @ m.astype(float), 36 * v, atol=1e-12)


def test_close_roots_are_told_apart():
    big = 10**30
    values = [(a, b) for a, b, _ in principal_roots(product([-big, 1], [-(big + 1), 1], [-1, 1]), 3 * big, 3)]
    assert [round(a / 2**b) for a, b in values] == [big + 1, big, 1] or [(a + (1 << (b - 1))) >> b for a, b in values] == [big + 1, big, 1]


def test_primes():
    assert primes_below(30, 10) == [29, 23, 19, 17, 13, 11, 7, 5, 3, 2]
    assert primes_below(1 << 31, 2) == [2147483647, 2147483629]


def test_products_of_any_size():
    x = np.array([[1 << 61, -3, 5], [-(1 << 62), 1 << 40, -1], [7, -(1 << 21), 0]], np.int64)
    assert (exact_products(x) == x.T.astype(object).dot(x.astype(object))).all()


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    x = (r.normal(size=(400, 6)) @ r.normal(size=(6, 6)) * 0.3).round(3)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (900, None), (901, [1.0, None] * 3), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, []), (905, [1.0])]
    return spark.createDataFrame([(*row, 7, 0.5, 1) for row in rows], "vec_id long, embedding array<double>, component int, whitened double, n int").repartition(4)


def test_query_against_numpy(vectors):
    got = whitened_components(vectors, components=4).collect()
    rows = [r for r in vectors.collect() if r.embedding and len(r.embedding) == 6 and all(v is not None and math.isfinite(v) for v in r.embedding)]
    x = np.array([[math.floor(64 * v) + 1000000 for v in r.embedding] for r in rows])
    n, s = len(x), x.sum(0)
    cov = np.cov(x.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    assert len(got) == 4 * n == 4 * 402
    by = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[-r.component] / cov.trace()) < 1e-12
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    for r, row in zip(rows, x):
        found = by[r.vec_id, int(((n * row.astype(object) - s) ** 2).sum())]
        for c in range(1, 5):
            want = (row - s / n) @ axes[:, -c] / math.sqrt(values[-c])
            assert abs(abs(found[c][0]) - abs(want)) < 1e-8
    assert by.keys() >= {(0, k) for v, k in by if v == 0}


def test_degenerate_tables(spark):
    kind = "vec_id string, embedding array<float>"
    assert whitened_components(spark.createDataFrame([], kind)).count() == 0
    assert whitened_components(spark.createDataFrame([("a", [1.0, 2.0])] * 3, kind)).count() == 0  # no variance
    line = spark.createDataFrame([(str(i), [float(i), 2.0 * i, -1.0]) for i in range(50)], kind)
    got = whitened_components(line).collect()  # one direction only
    assert {r.component for r in got} == {1} and len(got) == 50
    assert all(r.explained == 1.0 and r.identity_error < 1e-9 for r in got)
    huge = spark.createDataFrame([("a", [1e300, 0.0]), ("b", [-1e300, 1.0]), ("c", [0.0, 3.0])], "vec_id string, embedding array<double>")
    assert all(r.deviation is None for r in whitened_components(huge).where("vec_id <> 'c'").collect())
