"""Whitening against LAPACK on the same fit list."""

import numpy as np
import pytest

from textloom.llm import whitening


def brute(rows, k):
    """Fit list, eigenvalues and vectors of it, by forming the covariance."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    x = [tuple(int(np.floor(256 * np.float64(c))) for c in v) + (0,) * (d - len(v)) for _, v in kept]
    fit = np.array(sorted(set(x)), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in kept], np.array(x), n, s, e[::-1][:k], u[:, ::-1][:, :k], e.sum()


def vectors(n=300, d=9, seed=1):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)) * np.linspace(2, 0.3, d)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a vector that many share
    return rows + [(2000, None), (2001, [1.0] * (d - 1) + [None]), (2002, [float("nan")] * d), (2003, [float("inf")] + [0.0] * (d - 1)), (None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1]), (2004, [0.5] * (d - 2)), (2005, [])]


@pytest.mark.parametrize(("d", "spare"), [(9, 12), (9, 1), (40, 12), (40, 2)])
def test_components_equal_lapack(spark, d, spare):
    rows = vectors(d=d)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    _, _, n, s, e, u, _ = brute(rows, 4)
    fit, centre = whitening.fit_list(whitening.whole_vectors(df, "embedding", {"id": "vec_id"}))
    got_e, got_u, _, size = whitening.components(fit, centre, 4, spare)
    assert centre.n == n and centre.sums == s.tolist()
    assert np.allclose(got_e, e, rtol=1e-12)
    assert np.allclose(np.abs((got_u * u).sum(axis=0)), 1, atol=1e-12)
    assert max(size) < 1e-12


def test_rows_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 7, 8) for i, v in rows], "vec_id long, embedding array<float>, x int, n int").repartition(3)
    ids, x, n, s, e, u, trace = brute(rows, 4)
    got = [r.asDict() for r in whitening.whiten(df).collect()]
    assert sorted(((r["vec_id"], r["component"]) for r in got), key=repr) == sorted(((i, c) for i in ids for c in (1, 2, 3, 4)), key=repr)
    want = {}
    for i, v in zip(ids, x, strict=True):
        y = (n * v - s) / n
        want[i] = (int(((n * v - s) ** 2).sum()), y @ u / np.sqrt(e))
    sign = {}
    for r in got:
        c, (deviation, w) = r["component"], want[r["vec_id"]]
        sign.setdefault(c, np.sign(r["whitened"] * w[c - 1])) if abs(w[c - 1]) > 1e-3 else None
        assert r["n"] == n and r["deviation"] == deviation
        assert abs(r["explained"] - e[c - 1] / trace) < 1e-12
        assert r["identity_error"] < 1e-10
    for r in got:
        assert abs(r["whitened"] * sign[r["component"]] - want[r["vec_id"]][1][r["component"] - 1]) < 1e-9


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect() == []
    two = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.75, 1.0]), (3, [0.5, 1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9))) for r in two) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]
    assert {r["explained"] for r in two} == {1.0}


def test_large_numbers_are_exact(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 3.0]), (3, [2e15, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df, 1).collect()
    assert len(got) == 3 and all(r["deviation"] is None and np.isfinite(r["whitened"]) for r in got)
    df = spark.createDataFrame([(1, [1e6]), (2, [2e6])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(df).collect()} == {256000000**2}
