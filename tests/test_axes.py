"""Axes of terms from one pass over the sessions."""

import numpy as np
import pytest

from trailmark.operators import features as ft


def test_axes_of_one_pass_are_those_of_numpy(spark, monkeypatch):
    from pyspark.mllib.linalg.distributed import RowMatrix

    rng = np.random.default_rng(1)
    x = np.where(rng.random((60, 12)) < 0.4, rng.random((60, 12)), 0.0)
    x[:, 11] = 0
    x[0, 0] = 1
    weights = spark.createDataFrame([(int(i), f"t{j:02}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "SessionId long, term string, weight double")
    by_passes = RowMatrix.computeSVD
    monkeypatch.setattr(RowMatrix, "computeSVD", lambda *a, **k: pytest.fail("a pass over the sessions for each iteration"))
    axes, values = ft.right_vectors(weights, 5)
    _, s, v = np.linalg.svd(x[:, :11], full_matrices=False)
    got = np.array([a for _, a in axes])
    assert [t for t, _ in axes] == [f"t{j:02}" for j in range(11)] and values == pytest.approx(s[:5])
    assert np.abs((got * v[:5].T).sum(axis=0)) == pytest.approx(1) and (got[np.abs(got).argmax(axis=0), range(5)] > 0).all()
    dense = {r.SessionId: np.array(r.category_dense) for r in ft.project(weights, axes).collect()}
    for i in np.flatnonzero(x.any(axis=1)):
        want = x[i, :11] @ got
        assert dense[i] == pytest.approx(want / np.linalg.norm(want))
    monkeypatch.setattr(RowMatrix, "computeSVD", by_passes)
    monkeypatch.setattr(ft, "GRAM", 3)
    again, values = ft.right_vectors(weights, 5)
    assert values == pytest.approx(s[:5]) and np.abs((np.array([a for _, a in again]) * got).sum(axis=0)) == pytest.approx(1)
