"""Principal components from tiled Gram tables, and the comparisons built on them, against numpy and plain Python."""

import math

import numpy as np
import pytest

from regulus.operators import expression as X
from regulus.operators import matrix as M


def table(spark, x):
    return spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(3)


def expected(x, c):
    z = x - x.mean(axis=1, keepdims=True)
    val, vec = np.linalg.eigh(z.T @ z)
    val, vec = val[::-1][:c], vec[:, ::-1][:, :c]
    vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), np.arange(c)])
    return vec * np.sqrt(np.maximum(val, 0)), val / (z * z).sum()


def scores(df, names, c):
    got = {(r.sample, r.component): r for r in df.collect()}
    return (np.array([[got[n, k + 1].score for k in range(c)] for n in names]), np.array([got[names[0], k + 1].variance_fraction for k in range(c)]))


@pytest.mark.parametrize("tile, whole", [(512, 1024), (4, 1024), (4, 5)])
def test_components_in_any_tiling(spark, monkeypatch, tile, whole):
    monkeypatch.setattr(M, "TILE", tile)
    monkeypatch.setattr(M, "WHOLE_SAMPLES", whole)
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 11)) * np.linspace(3, 1, 11)
    names = [f"s{i}" for i in range(11)]
    got, share = scores(M.pca_scores(table(spark, x), names, 11), names, 11)
    want, frac = expected(x, 11)
    assert np.allclose(got[:, :10], want[:, :10], atol=1e-6) and np.allclose(share, frac, atol=1e-9)
    z = x - x.mean(axis=1, keepdims=True)
    assert np.allclose(got @ got.T, z.T @ z, atol=1e-6)  # all components give the Gram matrix back
    cross = got.T @ got
    assert np.allclose(cross, np.diag(np.diag(cross)), atol=1e-6) and (np.diff(np.diag(cross)) <= 1e-9).all()
    full = {(q.i, q.j): q.sij for q in M.gram(table(spark, x), names).collect()}
    assert len(full) == 121 and np.allclose([full[i, j] for i in range(11) for j in range(11)], (x.T @ x).ravel())


def test_many_samples(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(30, 3)) * [9, 5, 3]
    x = base @ r.normal(size=(3, 1300)) + r.normal(size=(30, 1300)) * 0.1
    names = [f"s{i}" for i in range(1300)]  # more than a task sums as a whole
    got, share = scores(M.pca_scores(table(spark, x), names, 3), names, 3)
    want, frac = expected(x, 3)
    assert np.allclose(got, want, atol=1e-6) and np.allclose(share, frac, atol=1e-9)


def test_odd_tables(spark):
    names = ["a", "b", "c"]
    assert M.pca_scores(table(spark, np.zeros((0, 3))), names, 2).count() == 0
    flat = M.pca_scores(table(spark, np.ones((4, 3))), names, 2).collect()
    assert len(flat) == 6 and all(q.score == 0 and q.variance_fraction == 0 for q in flat)
    assert M.pca_scores(table(spark, np.eye(3)), names, 7).count() == 9  # no more components than samples


def test_component_against_stage(spark):
    stage = {"a": 1.0, "b": 2.0, "c": 4.0, "d": 8.0}
    x = np.outer([3.0, -2.0, 1.0, 0.5], list(stage.values())) + np.random.default_rng(3).normal(size=(4, 4)) * 0.01
    rows = {q.sample: q for q in M.component_against_stage(table(spark, x), stage).collect()}
    want, _ = expected(x, 1)
    assert np.allclose([rows[s].pc1 for s in stage], want[:, 0], atol=1e-8)
    assert math.isclose(rows["a"].r, np.corrcoef(want[:, 0], list(stage.values()))[0, 1], abs_tol=1e-9)


def test_balanced_contrast(spark):
    # study p has three times as many "on" rows: the plain difference is biased, the balanced one is 1
    rows = [("g", "p", "on", 11.0)] * 3 + [("g", "p", "off", 1.0), ("g", "q", "on", 10.0), ("g", "q", "off", 0.0)]
    rows += [(None, "p", "on", 2.0), (None, "q", "on", 1.0), (None, "q", "off", None), ("h", "z", "on", 5.0), ("g", "p", "other", 99.0), ("g", None, "on", 7.0)]
    df = spark.createDataFrame(rows, "gene string, study string, status string, v double")
    got = {r.gene: tuple(r)[1:] for r in X.balanced_contrast(df, ["gene"], "study", ("p", "q"), "status", ("on", "off"), "v").collect()}
    assert got == {"g": (2, 1.0, 8.5 - 5.0), None: (1, None, 1.0)}


def test_residuals_by_class(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 3.5), ("a", 3.0, 7.0), (None, 4.0, 7.5), (None, 5.0, 11.0), ("b", 1.0, None), ("c", 6.0, 11.5)]
    got = {r["class"]: r for r in X.residual_by_class(spark.createDataFrame(rows, "class string, x double, y double"), "class", "x", "y").collect()}
    ok = [r for r in rows if r[2] is not None]
    b, a = np.polyfit([r[1] for r in ok], [r[2] for r in ok], 1)
    for k in ("a", None, "c"):
        e = np.array([(x, abs(y - a - b * x)) for c, x, y in ok if c == k])
        assert got[k].n == len(e) and math.isclose(got[k].mean_abs_residual, e[:, 1].mean())
        assert got[k].corr_residual_level is None if len(e) < 2 else math.isclose(got[k].corr_residual_level, np.corrcoef(e.T)[0, 1])
    assert set(got) == {"a", None, "c"}
