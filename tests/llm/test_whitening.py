"""Whitening against plain sums in whole numbers."""

import math

import numpy as np
import pytest

from chronovox.llm import queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def table(n=400, d=40, seed=5):
    rng = np.random.default_rng(seed)
    a = (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3 + rng.normal(size=d) * 3).astype(np.float32)
    return [(k, a[k].tolist(), k % 3) for k in range(n)]


BAD = [(9001, None, 1), (9002, [math.nan] + [0.0] * 39, 1), (9003, [math.inf] + [0.0] * 39, 1), (9004, [None] + [0.0] * 39, 1)]


def test_moments_merge_in_any_grouping():
    rng = np.random.default_rng(2)
    a = np.floor(rng.normal(size=(500, 7)) * 200) + 1000000
    whole = whitening.Moments.of(a)
    for cuts in ([1], [100, 101, 499], list(range(1, 500, 7))):
        m = whitening.Moments.none()
        for part in np.split(a, cuts):
            m = m.merged(whitening.Moments.unpacked(whitening.Moments.of(part).packed()))
        assert m.n == 500 and m.sums() == whole.sums() == [int(s) for s in a.astype(np.int64).sum(0)]
        assert np.allclose(m.scatter, np.cov(a.T, bias=True) * 500, rtol=1e-12, atol=1e-6)
    assert whitening.Moments.unpacked(whitening.Moments.none().packed()).n == 0


def test_the_query(spark, tmp_path):
    rows = table() + BAD + [(7, table()[7][1], 0), (None, table()[8][1], 0)]  # a repeated id, a null one
    spark.createDataFrame(rows, VECTORS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op12_whitening(spark, str(tmp_path)).collect()
    fit = [r for r in rows if r[0] is None or r[0] < 9000]
    x = np.array([[math.floor(c * 64) + 1000000 for c in r[1]] for r in fit], np.int64)
    n, s = len(x), x.sum(0)
    v = (x - s / n).T @ (x - s / n) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    want = (x - s / n) @ axes / np.sqrt(values)
    assert len(out) == n * 32 and {r["n"] for r in out} == {n} and len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9
    got = {}
    for r in out:
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for k, r in enumerate(fit):
        deviation = sum((n * int(c) - int(t)) ** 2 for c, t in zip(x[k], s, strict=True))
        for c in range(32):
            for g in got[(r[0], c + 1)]:
                assert g["deviation"] == deviation and abs(g["explained"] - values[c] / np.trace(v)) < 1e-12
                assert abs(abs(g["whitened"]) - abs(want[k, c])) < 1e-8
                if abs(want[k, c]) > 1e-6:
                    signs.setdefault(c, set()).add(np.sign(g["whitened"] * want[k, c]))
    assert all(len(s) == 1 for s in signs.values())


def test_defined_results(spark):
    make = lambda rows: whitening.usable(spark.createDataFrame(rows, VECTORS))
    for rows in ([], [(1, [1.0, 2.0], 0)], [(k, [1.0, 2.0], 0) for k in range(5)], [(1, [], 0)]):
        df = make(rows)
        w = whitening.fit(df)
        assert w.fitted.n == len(rows) and whitening.whitened(df, w).count() == 0 and whitening.identity_error(df, w) == 0
    line = make([(k, [float(k), 2.0 * k], 0) for k in range(6)])  # one dimension of two
    w = whitening.fit(line)
    assert w.variances.shape == (1,) and whitening.whitened(line, w).count() == 6 and whitening.identity_error(line, w) < 1e-12
    with pytest.raises(Exception, match="number of dimensions"):
        whitening.fit(make([(1, [1.0, 2.0], 0), (2, [1.0], 0)]))
    with pytest.raises(Exception, match="whole numbers"):
        halves = make([(1, [0.5], 0), (2, [1.0], 0)])
        whitening.whitened(halves, whitening.fit(halves)).count()
    with pytest.raises(Exception, match="fit a long"):
        far = make([(1, [-1.5 * 2**31], 0), (2, [2.0**31], 0), (3, [2.0**31], 0)])
        whitening.whitened(far, whitening.fit(far)).count()
