from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import covariance, loglik

from tidewright.functions.families import CandidateError, candidate, labels, parameters
from tidewright.functions.outcomes import CODES
from tidewright.operators.fitting import Axis, fit_batch, products, profile
from tidewright.operators.lint import lint

N = 60
T = 2000 + np.arange(N) / 12
X = np.stack([np.ones(N), T - T.mean()], 1)
AXIS = Axis(T, X, 1)


def drawn(rows: int, seed: int = 5) -> np.ndarray:
    cov = covariance(T, 0.5, 1.0, 0.2)
    return (np.linalg.cholesky(cov) @ np.random.default_rng(seed).normal(size=(N, rows))).T + 0.4 * (T - T.mean())


@pytest.mark.parametrize("objective", ["ml", "reml"])
def test_fit_reaches_the_dense_likelihood_and_an_optimum(objective):
    y = drawn(6)
    y[0, 10:30] = np.nan
    got = fit_batch(y, AXIS, candidate("white + matern12"), objective, 200)
    ok = np.flatnonzero(got["outcome"] == 0)
    assert len(ok) >= 4
    for i in ok:
        on = np.isfinite(y[i])
        value = lambda th, on=on, i=i: loglik(y[i][on], covariance(T[on], th[0], th[1], th[2]), X[on], objective == "reml")
        assert got["loglik"][i] == pytest.approx(value(got["theta"][i]), abs=1e-8)
        for j in range(3):
            for f in (0.97, 1.03):
                other = got["theta"][i].copy()
                other[j] *= f
                assert value(other) <= got["loglik"][i] + 1e-6
        assert got["n"][i] == on.sum() - (2 if objective == "reml" else 0)
        assert got["k"][i] == (3 if objective == "reml" else 5)


def test_composite_products_match_dense():
    y = drawn(3)
    theta = np.tile([0.7, 0.3, 0.4, 1.5, 0.2], (3, 1))
    kinds = candidate("white + matern32 + matern12")
    assert kinds == ("matern12", "matern32", "white")
    got = profile(*products(y, AXIS, kinds, theta), np.zeros(3), "ml")
    cov = covariance(T, 0.7, 0.3, 0.0) + covariance(T, 0.4, 1.5, 0.2, True)
    for i in range(3):
        assert got["loglik"][i] == pytest.approx(loglik(y[i], cov, X), abs=1e-8)


def test_batch_equals_solo():
    y = drawn(4)
    whole = fit_batch(y, AXIS, candidate("matern12 + white"), "ml", 50)
    for i in range(4):
        alone = fit_batch(y[i : i + 1], AXIS, candidate("matern12 + white"), "ml", 50)
        np.testing.assert_allclose(alone["loglik"][0], whole["loglik"][i], rtol=0, atol=1e-9, equal_nan=True)


def test_outcomes():
    y = drawn(4)
    y[0] = np.nan
    y[1, 1:] = np.nan  # one sample, two columns
    y[2] = 0.0
    got = fit_batch(y, AXIS, candidate("white"), "ml", 200)
    assert got["outcome"][0] == CODES["INSUFFICIENT_DATA"]
    assert got["outcome"][1] == CODES["RANK_DEFICIENT_X"]
    assert got["outcome"][2] != 0
    assert got["outcome"][3] == 0
    bad = got["outcome"] != 0
    assert np.isnan(got["loglik"][bad]).all() and np.isnan(got["theta"][bad]).all()
    assert fit_batch(y, AXIS, candidate("white + matern12"), "ml", 1)["outcome"][3] in (CODES["ITER_CAP_SMALL_GRAD"], CODES["ITER_CAP_LARGE_GRAD"])


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.integers(0, N - 1), min_size=5, max_size=30, unique=True))
def test_masked_equals_absent(seed, gone):
    y = drawn(1, seed)
    y[0, gone] = np.nan
    theta = np.array([[0.5, 0.8, 0.3]])
    on = np.isfinite(y[0])
    a = products(y, AXIS, ("matern12", "white"), theta)
    b = products(y[:, on], Axis(T[on], X[on], 1), ("matern12", "white"), theta)
    for u, v in zip(a, b, strict=True):
        np.testing.assert_allclose(u, v, rtol=1e-8, atol=1e-8)


def test_candidates_and_lint():
    assert labels(candidate("white + matern12 + matern12")) == ["matern12[0]", "matern12[1]", "white[0]"]
    assert parameters(candidate("white + matern12")) == [("matern12[0]", "sigma"), ("matern12[0]", "rho"), ("white[0]", "sigma")]
    with pytest.raises(CandidateError):
        candidate("white * matern12")
    rules = lambda c, dt, **p: [f.rule for f in lint(c, dt, **p)]
    assert rules("white + white", 0.1) == ["nugget_collapse"]
    assert rules("white + matern12", 100) == ["white_collapse"]
    assert rules("matern12", 100) == ["timescale_unidentified"]
    assert rules("matern12 + matern12", 0.1) == ["same_kind_free_timescales"]
    assert rules("matern12 + matern12", 0.1, pinned={"matern12[0]": 1.0, "matern12[1]": 1.4}) == ["same_kind_pinned_overlap"]
    assert rules("", 1) == ["no_noise_terms"]
    assert not rules("white + matern12", 0.1)
