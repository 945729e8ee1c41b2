"""Mixtures of all sizes settle in shared passes."""

import numpy as np
import pytest

from trailmark.config import PrototypeConfig
from trailmark.operators import prototypes as pt


def test_all_mixtures_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (80, 3)) for c in (-2, 0, 3)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "SessionId long, features array<double>")
    cfg = PrototypeConfig(components=(2, 3, 4), n_init=2, max_iter=12)
    alone = [pt.fit_mixture(rows, k, c, cfg) for c in cfg.covariances for k in cfg.components]
    passes, expect = [], pt._expect
    monkeypatch.setattr(pt, "_expect", lambda *a: passes.append(1) or expect(*a))
    best, table = pt.select_mixture(rows, None, cfg)
    assert len(passes) <= cfg.max_iter + 1
    assert {(r["K"], r["covariance_type"], r["n_iter"]) for r in table} == {(len(m.weights), m.covariance_type, m.n_iter) for m in alone}
    n, ll, w, s, q = expect(rows, [best])[0]
    r, total = best.posterior(x)
    assert (n, ll) == (240, pytest.approx(total.sum())) and w == pytest.approx(r.sum(axis=0)) and s == pytest.approx(r.T @ x)
    assert q == pytest.approx(np.einsum("nk,ni,nj->kij", r, x, x) if best.covariance_type == "full" else r.T @ x**2)
    monkeypatch.setattr(pt, "_DIRECT", 0)
    assert expect(rows, [best])[0][4] == pytest.approx(q)


def test_a_mixture_is_factored_once(monkeypatch):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(3, 20, 20))
    m = pt.Mixture(np.full(3, 1 / 3), rng.normal(size=(3, 20)), a @ a.transpose(0, 2, 1) + np.eye(20), "full")
    x, inverted, inv = rng.normal(size=(50, 20)), [], np.linalg.inv
    monkeypatch.setattr(np.linalg, "inv", lambda c: inverted.append(1) or inv(c))
    found = [m.log_probabilities(x[lo : lo + 10]) for lo in range(0, 50, 10)]
    assert len(inverted) == 1
    for k in range(3):
        y = x - m.means[k]
        square = np.einsum("ni,ij,nj->n", y, inv(m.covariances[k]), y)
        want = -0.5 * (20 * np.log(2 * np.pi) + np.linalg.slogdet(m.covariances[k])[1] + square) + np.log(1 / 3)
        assert np.concatenate(found)[:, k] == pytest.approx(want)
