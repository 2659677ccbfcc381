import math
import random
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomgraph.llm import charpoly, whiten

SF = "/root/testdata/sf0.001"


def exact_polynomial(matrix):
    """Coefficients of det(x - matrix), the constant one first, by the recurrence of Faddeev and LeVerrier."""
    d, m = len(matrix), None
    out = [1]
    for k in range(1, d + 1):
        if m is None:
            m = [[int(i == j) for j in range(d)] for i in range(d)]
        else:
            m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        trace = sum(matrix[i][t] * m[t][i] for i in range(d) for t in range(d))
        out.append(-Fraction(trace, k))
    return [int(c) for c in reversed(out)]


def symmetric(draw, d, size):
    half = [[draw.randint(-size, size) for _ in range(d)] for _ in range(d)]
    return [[sum(half[i][t] * half[j][t] for t in range(d)) for j in range(d)] for i in range(d)]


def polynomial(matrix):
    primes = charpoly.primes_for(charpoly.coefficient_bits(matrix))
    return charpoly.combined(primes, [charpoly.charpoly_mod(matrix, p) for p in primes])


@pytest.mark.parametrize("d", [1, 2, 3, 5, 9])
def test_polynomial_is_exact(d):
    draw = random.Random(d)
    for size in (1, 50, 10**9):
        matrix = symmetric(draw, d, size)
        assert polynomial(matrix) == exact_polynomial(matrix)
    zeros = [[0] * d for _ in range(d)]
    assert polynomial(zeros) == exact_polynomial(zeros)


def test_primes():
    plain = [n for n in range(2, 3000) if all(n % k for k in range(2, math.isqrt(n) + 1))]
    assert [n for n in range(3000) if charpoly.is_prime(n)] == plain
    assert charpoly.primes_for(10)[0] == 2**31 - 1


def test_repeated_roots():
    """Roots 12, 5, 5, 5, 2, 0 in a turned base, found as often as they occur."""
    draw = random.Random(2)
    turn = np.eye(6, dtype=object)
    for _ in range(4):
        # Reflections by whole vectors, scaled so that everything stays whole.
        v = np.array([draw.randint(-2, 2) or 1 for _ in range(6)], dtype=object)
        turn = turn @ (np.eye(6, dtype=object) * int(v @ v) - 2 * np.outer(v, v))
    scale = int((turn @ turn.T)[0, 0])
    matrix = (turn @ np.diag(np.array([12, 5, 2, 5, 0, 5], dtype=object)) @ turn.T).tolist()
    roots = charpoly.largest_roots(polynomial(matrix), 6)
    assert [float(charpoly.decimal_root(r)) / scale for r in roots] == pytest.approx([12, 5, 5, 5, 2], rel=1e-15)
    assert len(set(roots)) == 3
    base = charpoly.null_vectors(matrix, roots[1], 3)
    assert np.allclose(base @ base.T, np.eye(3), atol=1e-15)
    assert np.allclose(base @ np.array(matrix, float) / scale, 5 * base, atol=1e-12)


def test_close_roots_are_told_apart():
    """Eigenvalues that differ by one part in 10 ** 18, beyond double precision."""
    matrix = [[10**18, 0, 0], [0, 10**18 + 1, 0], [0, 0, 7]]
    roots = charpoly.largest_roots(polynomial(matrix), 3)
    assert [int(charpoly.decimal_root(r)) for r in roots] == [10**18 + 1, 10**18, 7]
    found = [charpoly.null_vectors(matrix, r, 1)[0] for r in roots]
    assert np.allclose(np.abs(found), [[0, 1, 0], [1, 0, 0], [0, 0, 1]], atol=1e-15)


def plainly(vectors, components=16):
    """{index: (deviation, whitened up to sign, explained)} with exact sums and the library's eigenvectors."""
    clean = {k: [math.floor(64 * c) + 1_000_000 for c in v] for k, v in vectors.items()
             if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, clean.values())))
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[n * x[j] - s[j] for j in range(d)] for x in fit], float) / n
    values, base = np.linalg.eigh(centred.T @ centred / n)
    values, base = values[::-1][:components], base[:, ::-1][:, :components]
    out = {}
    for k, x in clean.items():
        moved = [n * a - b for a, b in zip(x, s, strict=True)]
        white = np.array(moved, float) / n @ base / np.sqrt(values)
        out[k] = (n, sum(v * v for v in moved), white, values / np.trace(centred.T @ centred / n))
    return out


def check(rows, want, components):
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(want)
    signs = None
    for k, (n, deviation, white, explained) in want.items():
        mine = [got[k][c] for c in range(1, components + 1)]
        assert all(r.n == n and int(r.deviation) == deviation for r in mine) and len(got[k]) == components
        assert [r.explained for r in mine] == pytest.approx(explained, rel=1e-9)
        if signs is None and np.abs(white).min() > 1e-3:
            signs = np.sign([r.whitened for r in mine]) * np.sign(white)
    for k, (_, _, white, _) in want.items():
        assert np.allclose([got[k][c].whitened for c in range(1, components + 1)], white * signs, atol=1e-8)


def test_query(spark):
    import __spark_entry__ as spark_entry

    rows = spark_entry.queries()["op11_whitening"](spark, SF).collect()
    vectors = {r["vec_id"]: r["embedding"] for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()}
    check(rows, plainly(vectors), 16)
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9


def table(spark, vectors):
    rows = [(k, v, "x", "y") for k, v in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component string")


def test_odd_rows(spark):
    draw = random.Random(9)
    nan, inf = float("nan"), float("inf")
    vectors = [(k, [draw.gauss(0, 1 + j) for j in range(5)]) for k in range(40)]
    vectors += [(100 + k, vectors[0][1]) for k in range(60)] + [(None, vectors[1][1])]
    odd = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [nan] * 5), (203, [inf, 0.0, 0.0, 0.0, 0.0]), (204, []), (205, [1.0])]
    rows = whiten.whiten(table(spark, vectors + odd)).collect()
    check(rows, plainly(dict(vectors)), 5)
    assert {r.n for r in rows} == {40}


def test_fewer_vectors_than_dimensions(spark):
    rows = whiten.whiten(table(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9), r.explained) for r in rows) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    assert whiten.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten.whiten(table(spark, [(1, None)])).count() == 0


def test_large_entries_stay_exact(spark):
    vectors = {k: [float(2**40 + k), float(-(2**41)) * k] for k in range(1, 6)}
    rows = whiten.whiten(table(spark, list(vectors.items())), components=1).collect()
    want = plainly(vectors, 1)
    assert {r.vec_id: int(r.deviation) for r in rows} == {k: v[1] for k, v in want.items()}
