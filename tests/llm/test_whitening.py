from fractions import Fraction
from math import floor

import numpy as np
import pytest

from effortlens.llm import bidiagonal, whitening
from effortlens.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """From the covariance matrix and its eigenvectors."""
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    grid = [(i, tuple(floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in grid})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    centre = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    values, directions = np.linalg.eigh(centre.T @ centre / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(16, int((values > 1e-9 * values[0]).sum())) if n > 1 else 0
    out = []
    for i, x in grid:
        difference = [n * c - s for c, s in zip(x, sums)]
        projected = np.array([float(Fraction(c, n)) for c in difference]) @ directions[:, :k] / np.sqrt(values[:k])
        out += [(i, j + 1, n, sum(c * c for c in difference), projected[j], values[j] / values.sum()) for j in range(k)]
    return out


def compare(found, wanted):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], round(abs(r[4]), 6))
    found = sorted((tuple(r) for r in found), key=key)
    wanted = sorted(wanted, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    if not found:
        return
    assert np.allclose([r[5] for r in found], [r[5] for r in wanted], rtol=1e-9)
    assert max(r[6] for r in found) < 1e-9
    for component in {r[1] for r in found}:
        a = np.array([r[4] for r in found if r[1] == component])
        b = np.array([r[4] for r in wanted if r[1] == component])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def vectors(seed=1, n=60, d=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(c) for c in rng.normal(size=d) * [3, 2, 1.5, 1, 0.5][:d]], 0) for i in range(n)]
    rows += [rows[3], (200, rows[3][1], 1), (None, rows[4][1], None), (201, None, 0), (202, [None] + [1.0] * (d - 1), 0)]
    rows += [(203, [float("nan")] * d, 0), (204, [float("inf")] + [0.0] * (d - 1), 0), (205, [0.0] * d, 0), (206, [], 0), (207, [1.0, 2.0], 0)]
    return rows


def found(spark, rows):
    return whitening.whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()


def test_brute_force_with_odd_rows(spark):
    rows = vectors()
    compare(found(spark, rows), brute([(i, v) for i, v, _ in rows if v is None or len(v) == 5]))


def test_other_columns_and_partitions(spark):
    rows = vectors(2, 900)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS x", "'b' AS n", "'c' AS component", "'d' AS part", "'e' AS r").repartition(40)
    compare(whitening.whitened_components(frame).collect(), brute([(i, v) for i, v, _ in rows if v is None or len(v) == 5]))


def test_few_equal_and_no_rows(spark):
    assert found(spark, []) == [] == found(spark, [(1, None, 0)]) == found(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])
    assert found(spark, [(1, [], 0), (2, [], 0)]) == []
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [2.0, 2.0, 5.0], 0), (3, [0.0, 7.0, 5.0], 0)]
    compare(found(spark, rows), brute([(i, v) for i, v, _ in rows]))


def test_numbers_a_long_cannot_hold(spark):
    rows = [(i, [3e38 * (-1) ** i, float(i)], 0) for i in range(4)] + [(9, [1.0, 2.0], 0)]
    got = found(spark, rows)
    assert {r["vec_id"] for r in got} == {0, 1, 2, 3, 9} and all(np.isfinite(r["whitened"]) for r in got)
    assert all(r["deviation"] is None for r in got if r["vec_id"] < 4)
    assert whitening._deviations(np.array([[3037000499, 0], [3037000500, 3037000500]], object)) == [3037000499**2, None]
    rng = np.random.default_rng(3)
    x, sums = rng.integers(-(1 << 40), 1 << 40, (5, 3)), [10**17 + 1, -5, 12345678901]
    for n in (7, 10**9, 10**12):
        assert whitening._differences(x, n, sums).tolist() == [[n * c - s for c, s in zip(r, sums)] for r in x.tolist()]


def orthogonal(rng, n):
    return np.linalg.qr(rng.normal(size=(n, n)))[0]


RNG = np.random.default_rng(5)
SPECTRA = [
    np.full(12, 2.0), np.r_[np.full(6, 3.0), np.full(6, 1.0)], 3 + 1e-9 * np.arange(12), np.r_[np.ones(4), np.zeros(8)],
    10.0 ** -np.arange(12), np.arange(12.0), 1 + 1e-4 * np.arange(12) ** 2,
]


@pytest.mark.parametrize("matrix", [
    *[orthogonal(RNG, 12) @ np.diag(s) @ orthogonal(RNG, 12) for s in SPECTRA], np.eye(5), np.ones((4, 4)), np.zeros((3, 3)),
    np.kron(np.eye(6), [[1.0, 2.0], [0.0, 1.0]]), np.triu(np.ones((30, 30))), np.array([[0.0, 1.0], [0.0, 0.0]]), RNG.normal(size=(40, 40)),
])
def test_singular_vectors(matrix):
    values, directions = bidiagonal.leading(matrix, 16)
    wanted = np.linalg.svd(matrix, compute_uv=False) ** 2
    top = max(wanted[0], 1e-300)
    assert len(values) == min(16, int((wanted > 1e-24 * top).sum())) or wanted[len(values)] < 1e-20 * top
    assert np.allclose(values, wanted[: len(values)], rtol=0, atol=1e-13 * top)
    assert np.abs(directions.T @ directions - np.eye(len(values))).max(initial=0) < 1e-13
    assert np.abs(matrix.T @ (matrix @ directions) - directions * values).max(initial=0) < 1e-13 * top


def test_small_values_keep_their_digits():
    """dqds is accurate relative to each value, however small."""
    q, e = 10.0 ** -np.arange(0, 40, 2.0), 0.3 * 10.0 ** -np.arange(1, 38, 2.0)
    n = len(q)
    # Exact: eigenvalues of the product with rational entries, by counting signs of pivots.
    values = bidiagonal.dqds(q, e)
    qf, ef = [Fraction(float(x)) for x in q], [Fraction(float(x)) for x in e]

    def below(x):
        count, pivot = 0, None
        for i in range(n):
            diagonal = qf[i] + (ef[i - 1] if i else 0) - x
            pivot = diagonal - (qf[i - 1] * ef[i - 1] / pivot if i else 0)
            count += pivot < 0
        return count

    for i, value in enumerate(values.tolist()):
        near = Fraction(value)
        assert below(near * Fraction(1 + 1e-13)) >= n - i and below(near * Fraction(1 - 1e-13)) <= n - 1 - i


def test_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = QUERIES["op13_embedding_whitening"](spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), brute(rows))
