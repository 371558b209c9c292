"""Spectrum slicing and whitening against plain NumPy."""

import math

import numpy as np
import pytest

from pacegrid.llm import whitening


def test_inertia_counts_are_those_of_the_eigenvalues():
    rng = np.random.default_rng(1)
    for dims in (1, 2, 3, 7, 20):
        for _ in range(20):
            a = rng.standard_normal((dims, dims))
            a = a + a.T
            if rng.random() < 0.5:
                np.fill_diagonal(a, 0)  # needs 2 x 2 pivots
            values = np.linalg.eigvalsh(a)
            for s in rng.uniform(values[0] - 1, values[-1] + 1, 8):
                assert whitening.above(a, s) == (values > s).sum()
    assert whitening.above(np.zeros((3, 3)), 0.0) == 0 and whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1, 0.5], [3, 3, 3, 1, 1, 0], [1, 1 - 1e-13, 0.2, 0.2, 0.1, 0], [1, 0, 0, 0, 0, 0], [1e-9, 1e-10, 1e-11, 1e-12, 0, 0], [1e9, 1, 1e-3, 0, 0, 0]])
def test_leading_eigenpairs(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((6, 6)))
    a = q @ np.diag(spectrum) @ q.T
    values, vectors = whitening.leading(a, 4)
    trace = sum(spectrum)
    want = [v for v in spectrum[:4] if v > 24 * np.finfo(float).eps * trace]
    np.testing.assert_allclose(values, want, atol=1e-14 * trace)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
    np.testing.assert_allclose(a @ vectors, vectors * values, atol=1e-13 * trace)
    assert whitening.leading(np.zeros((3, 3)))[1].shape == (3, 0)


def plain(vectors):
    """{component: (explained, {vector: (deviation, |whitened|)})}, n, by NumPy alone."""
    x = [tuple(int(math.floor(256.0 * float(c))) for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=object)
    n, sums = len(fit), fit.sum(0)
    y = (np.array(x, dtype=object) * n - sums).astype(np.float64) / n
    z = (fit * n - sums).astype(np.float64) / n
    v = z.T @ z / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    return n, deviation, np.abs(y @ axes / np.sqrt(values)), values / np.trace(v)


def test_whitened_rows_are_those_of_a_plain_computation(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    x = np.concatenate([x, np.repeat(x[:1], 150, 0), x[:20] + 1e-4]).astype(np.float32)
    rows = [(k if k % 9 else 1, v.tolist(), "other", 0.5) for k, v in enumerate(x)]
    rows += [(900, None, "a", 0.0), (901, [1.0, None, 2.0, 1.0, 1.0, 1.0], "a", 0.0), (902, [float("nan")] * 6, "a", 0.0), (903, [float("-inf")] * 6, "a", 0.0), (904, [], "a", 0.0), (905, [1.0, 2.0], "a", 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, whitened double").repartition(5)
    got = whitening.whiten(df).orderBy("vec_id", "deviation", "component").toPandas()
    n, deviation, whitened, explained = plain(x)
    assert len(got) == 4 * len(x) and set(got["n"]) == {n} and not set(got["vec_id"]) & set(range(900, 906))
    want = sorted((r[0], d, c + 1, w[c]) for r, d, w in zip(rows, deviation, whitened) for c in range(4))
    have = sorted(zip(got["vec_id"], got["deviation"], got["component"], got["whitened"].abs()))
    for a, b in zip(want, have):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-9)
    for c in range(4):
        np.testing.assert_allclose(got["explained"][got["component"] == c + 1].unique(), [explained[c]], rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_partitions_without_rows(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(k, [float(k), float(k * k)]) for k in range(5)], "vec_id long, embedding array<float>").repartition(9)
        assert whitening.whiten(df).count() == 10
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(None, [1.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, -0.0])], schema)).collect()
    assert [r["component"] for r in line] == [1, 1, 1] and {r["deviation"] for r in line} == {512**2} and {round(abs(r["whitened"]), 12) for r in line} == {1.0}


def test_wide_numbers_stay_exact():
    centre = whitening.Centre(10**9, [10**18, -(10**17)], 1 << 40)
    x = np.array([[3, 1 << 40], [-(1 << 40), 5]])
    assert not centre.narrow and centre.deviation(x) == [None, None]
    near = whitening.Centre(3, [10, 11], 1 << 30)
    y = np.array([[1 << 30, 4], [2, 3]])
    assert near.deviation(y) == [None if (v := (3 * int(a) - 10) ** 2 + (3 * int(b) - 11) ** 2) >= 1 << 63 else v for a, b in y]
    np.testing.assert_allclose(near(y), y - np.array([10, 11]) / 3)
    assert centre(x)[0, 0] == pytest.approx((3 * 10**9 - 10**18) / 10**9)
