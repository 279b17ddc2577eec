import math
import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from tierstone.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int, component string"


def vectors(spark, *rows):
    """(id, vector) rows with columns of clashing names besides."""
    return spark.createDataFrame([(i, v, "x", 7, "c") for i, v in rows], SCHEMA)


def integers(v):
    return tuple(math.floor(256 * float(np.float32(c))) for c in v)


def brute(rows):
    """n, deviations, eigenvalues and components of the covariance by numpy, over the distinct vectors."""
    kept = [(i, integers(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    deviation = {x: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in fit}
    centred = np.array(fit, float) - np.array(sums) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, deviation, values[::-1], basis[:, ::-1]


def test_equals_numpy_on_distinct_vectors(spark):
    draw = random.Random(5)
    base = [[draw.gauss(0, 1 + (k < 5) * (5 - k)) for k in range(12)] for _ in range(200)]
    rows = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[0]) for i in range(300)]  # a hot vector counts once
    rows += [(None, base[1]), (7, base[2]), (2000, None), (2001, [None] * 12), (2002, [math.nan] * 12), (2003, [math.inf] + [0.0] * 11), (2004, [1.0, 2.0])]
    got = whitening.whitened(vectors(spark, *rows)).collect()
    kept, n, sums, deviation, values, basis = brute([r for r in rows if r[0] != 2004])
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    by_id = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for vec_id, x in kept:
        for k in range(4):
            r = by_id[vec_id, k + 1]
            if vec_id == 7:
                continue  # two rows of this id
            assert r["deviation"] == deviation[x] and r["deviation_digits"] == str(deviation[x])
            expected = float(basis[:, k] @ (np.array(x) - np.array(sums) / n) / math.sqrt(values[k]))
            sign = signs.setdefault(k, 1 if r["whitened"] * expected >= 0 else -1)
            assert r["whitened"] == pytest.approx(sign * expected, rel=1e-9, abs=1e-9)
            assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-12)
    assert all(r["identity_error"] < 1e-10 for r in got)
    assert sorted(r["deviation"] for r in got if r["vec_id"] == 7 and r["component"] == 1) == sorted(deviation[integers(v)] for v in (base[7], base[2]))


def test_polynomial_equals_exact_expansion(spark):
    draw = random.Random(1)
    rows = [[draw.randrange(-50, 50) for _ in range(6)] for _ in range(9)]
    matrix = [[sum(r[i] * r[j] for r in rows) for j in range(6)] for i in range(6)]
    # Faddeev and LeVerrier, in fractions
    size, coefficients = 6, [Fraction(1)]
    m = [[Fraction(0)] * size for _ in range(size)]
    for k in range(1, size + 1):
        m = [[sum(matrix[i][t] * m[t][j] for t in range(size)) + (coefficients[-1] if i == j else 0) for j in range(size)] for i in range(size)]
        coefficients.append(-Fraction(1, k) * sum(sum(matrix[i][t] * m[t][i] for t in range(size)) for i in range(size)))
    assert whitening.characteristic_polynomial(spark, matrix) == [int(c) for c in coefficients[::-1]]


def test_sums_and_deviations_stay_exact_beyond_64_bits(spark):
    draw = random.Random(3)
    x = np.array([[draw.randrange(-(1 << 62), 1 << 62) for _ in range(3)] for _ in range(700)] + [[-(1 << 63)] * 3], np.int64)
    expected = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(3)] for i in range(3)]
    assert whitening.products(x).tolist() == expected
    rows = [(i, [draw.uniform(-1e12, 1e12) for _ in range(3)]) for i in range(40)]
    got = whitening.whitened(vectors(spark, *rows)).collect()
    _, n, _, deviation, values, _ = brute(rows)
    digits = {r["vec_id"]: r["deviation_digits"] for r in got}
    assert digits == {i: str(deviation[integers(v)]) for i, v in rows} and all(r["deviation"] is None for r in got)
    assert len(got) == 120 and all(r["identity_error"] < 1e-9 for r in got)


def test_equal_roots_have_orthogonal_components():
    # a cross: four dimensions with the same variance, two with none
    matrix = [[10 if i == j and i < 4 else 0 for j in range(6)] for i in range(6)]
    poly = [0, 0, 10**4, -4 * 10**3, 6 * 10**2, -4 * 10, 1]
    roots = whitening.largest_roots(poly, 5)
    assert [(round(float(r), 12), m) for r, m in roots] == [(10.0, 4)]
    found = whitening.components(matrix, roots, 3)
    basis = np.array([[float(a) for a in v] for _, v in found])
    assert np.abs(basis @ basis.T - np.eye(3)).max() < 1e-14 and np.abs(basis[:, 4:]).max() < 1e-14


def test_close_and_small_roots_are_isolated():
    poly = [1]
    for root in (10**12 + 1, 10**12, 3000, 1, 0):
        poly = [(poly[i - 1] if i else 0) - root * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    found = whitening.largest_roots(poly, 9)
    assert [m for _, m in found] == [1, 1, 1, 1]
    assert all(abs(r - e) < e * Decimal(10) ** -59 for (r, _), e in zip(found, (10**12 + 1, 10**12, 3000, 1)))


def test_tables_without_components(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])], [(1, []), (2, [])]):
        got = whitening.whitened(vectors(spark, *rows))
        assert got.collect() == [] and got.columns[:3] == ["vec_id", "component", "n"]


def test_fewer_components_than_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 3.0]) for i in range(10)]  # one direction
    got = whitening.whitened(vectors(spark, *rows)).collect()
    assert len(got) == 10 and {r["component"] for r in got} == {1} and got[0]["explained"] == 1.0
