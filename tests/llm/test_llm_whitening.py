"""Whitening beside numpy's own eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import whitening as WH

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=4):
    keep = [(i, v) for i, v, _ in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    x = [tuple(math.floor(256 * float(np.float32(e))) + 0 for e in v) for _, v in keep]
    fit = np.array(sorted(set(x)), float)
    n, sums = len(fit), [sum(c) for c in zip(*sorted(set(x)))]
    cov = np.cov(fit.T, bias=True).reshape(len(sums), len(sums))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    return keep, np.array(x), n, sums, values[order], vectors[:, order], np.trace(cov), deviation


def check(spark, rows):
    told = WH.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("x", "dims", "n")})).collect()
    keep, x, n, sums, values, vectors, trace, deviation = brute(rows)
    k = len(values)
    assert len(told) == k * len(keep)
    by_id = {}
    for r in told:
        by_id.setdefault((r["vec_id"], r["component"]), []).append(r)
    for j in range(k):
        want = (x - np.array(sums) / n) @ vectors[:, j] / np.sqrt(values[j])
        mine = [by_id[i, j + 1][0]["whitened"] for i, _ in keep]
        assert np.allclose(mine, want, atol=1e-7) or np.allclose(mine, -want, atol=1e-7)
        for (i, _), d in zip(keep, deviation):
            r = by_id[i, j + 1][0]
            assert r["deviation"] == (d if d < 2**63 else None) and r["n"] == n
            assert r["explained"] == pytest.approx(values[j] / trace, rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) @ np.diag(np.linspace(3, 0.2, 12)) + 2
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist(), 1) for i in range(80)]
    bad = [(2000, None, 0), (2001, [1.0] * 11 + [None], 0), (2002, [float("nan")] * 12, 0), (2003, [float("inf")] + [0.0] * 11, 0), (2004, [], 0), (2005, [1.0], 0)]
    told = WH.whiten(spark.createDataFrame(rows + bad, SCHEMA))
    assert {r["vec_id"] for r in told.collect()} == {r[0] for r in rows}
    check(spark, rows)


def test_large_steps_and_minus_zero(spark):
    rows = [(i, [float(i * 100), (-0.0 if i % 2 else 0.0) if i % 3 else i * 0.3, float((i * 7) % 5) * 1e3], 0) for i in range(30)]
    check(spark, rows)
    check(spark, [(i, [a, b, c * 1e2], 0) for i, (a, b, c), _ in rows])


def test_degenerate(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert WH.whiten(empty).count() == 0
    one = WH.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0), (None, [0.5, 1.0], 0)], SCHEMA)).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 for r in one)
    assert WH.whiten(spark.createDataFrame([(1, [], 0)], SCHEMA)).count() == 0
    huge = WH.whiten(spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [0.0, 0.0], 0)], SCHEMA)).collect()
    assert len(huge) == 4 and all(r["deviation"] is None for r in huge)


@pytest.mark.parametrize("seed,n", [(0, 1), (1, 2), (2, 3), (3, 40), (4, 130)])
def test_components(seed, n):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n))
    a = a @ a.T
    k = min(4, n)
    values, rows = WH.leading_components(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    assert np.allclose(values, want, rtol=1e-12, atol=1e-12 * np.trace(a))
    assert np.abs(a @ rows.T - rows.T * values).max() <= 1e-11 * np.trace(a)
    assert np.allclose(rows @ rows.T, np.eye(k), atol=1e-13)


def test_repeated_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(20, 20)))
    for spectrum in ([5, 5, 5, 5, *[1] * 16], [3, 3, 2, 2, *[0] * 16], [1] * 20, [7, 0] * 10):
        a = q @ np.diag(np.array(spectrum, float)) @ q.T
        a = (a + a.T) / 2
        values, rows = WH.leading_components(a, 4)
        assert np.allclose(values, sorted(spectrum)[::-1][:4], atol=1e-12)
        assert np.abs(a @ rows.T - rows.T * values).max() < 1e-11 and np.allclose(rows @ rows.T, np.eye(4), atol=1e-13)
    values, rows = WH.leading_components(np.eye(9), 4)
    assert np.allclose(rows @ rows.T, np.eye(4), atol=1e-13) and np.allclose(values, 1)
