"""Whitening against a dense eigensolver, and its edge cases."""

import math
import random

import numpy as np
import pytest

from sparkwright.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, deviation string, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash", "clash") for i, v in vectors], SCHEMA)


def brute(vectors, most=16):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    covariance = centred.T @ centred / n
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    out = {}
    for i, x in kept:
        d = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        w = (n * np.array(x) - sums) / n @ basis / np.sqrt(values)
        for k in range(len(values)):
            out.setdefault((i, k + 1), []).append((n, d, w[k], values[k] / np.trace(covariance)))
    return out


def vectors(n=400, d=24, seed=1):
    rng = np.random.default_rng(seed)
    scales = np.linspace(0.2, 2.5, d)
    out = [(i, (rng.standard_normal(d) * scales).tolist()) for i in range(n)]
    return out + [(n + i, out[i % 7][1]) for i in range(60)]


def test_equals_dense_eigensolver(spark):
    rows = vectors()
    rows += [(rows[0][0], rows[0][1]), (None, rows[9][1]), (900, None), (901, [None] + [0.0] * 23), (902, [float("nan")] * 24), (903, [float("inf")] + [1.0] * 23), (904, []), (905, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, rows).repartition(7)).collect()
    want = brute([r for r in rows if r[0] is None or r[0] < 904])
    assert len(got) == sum(map(len, want.values()))
    flips = {}
    for r in got:
        n, d, w, e = want[(r.vec_id, r.component)][0]
        assert (r.n, r.deviation) == (n, d) and r.explained == pytest.approx(e, rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-8)
        if abs(w) > 1e-6:
            flips.setdefault(r.component, set()).add(r.whitened * w > 0)
    assert all(len(v) == 1 for v in flips.values()) and len(flips) == 16
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9


def test_large_offsets_keep_double_precision(spark):
    rng = random.Random(2)
    rows = [(i, [4000.0 + rng.randrange(100) / 64, -3000.0 + rng.randrange(9), 500.0 * (i % 2), 0.5]) for i in range(50)]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(frame(spark, rows)).collect()}
    for key, ((n, d, w, _),) in brute(rows, 3).items():
        assert (got[key].n, got[key].deviation) == (n, d)
        assert abs(got[key].whitened) == pytest.approx(abs(w), abs=1e-6)
    assert max(k for _, k in got) == 3  # the constant dimension has no variance


@pytest.mark.parametrize("size", [1e6, 3e7, 2e12])
def test_deviation_is_exact_or_null_beyond_a_long(spark, size):
    rows = [(i, [size * (i % 7 == 0), float(i), -2.5]) for i in range(50)]
    got = {r.vec_id: r for r in whitening.whiten(frame(spark, rows)).collect() if r.component == 1}
    for (i, k), ((n, d, w, _),) in brute(rows, 1).items():
        assert got[i].deviation == (d if d < 2**63 else None)
        assert abs(got[i].whitened) == pytest.approx(abs(w), abs=1e-6)


def test_few_rows(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, abs(round(r.whitened, 9))) for r in got) == [(1, 1, 2, 1.0), (2, 1, 2, 1.0), (3, 1, 2, 1.0)]


@pytest.mark.parametrize("values", [np.ones(12), np.r_[np.ones(6), np.full(6, 2.0)], np.logspace(0, -9, 40), np.r_[5.0, np.zeros(30)], np.arange(1.0, 65.0), np.array([3.0])])
def test_components_of_known_spectra(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, basis = whitening.components(a, 16)
    want = np.sort(values)[::-1]
    want = want[want > 0][:16]
    assert np.allclose(found, want, rtol=1e-6, atol=1e-14)
    assert np.allclose(basis.T @ basis, np.eye(len(want)), atol=1e-10)
    assert np.abs(a @ basis - basis * found).max() <= 1e-12 * np.abs(values).max()


def test_polar_factor():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    values, v = np.linalg.eigh(a)
    assert np.allclose(whitening.qdwh(a), (v * np.sign(values)) @ v.T, atol=1e-11)
