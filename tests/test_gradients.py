from __future__ import annotations

import dataclasses

import numpy as np
import pytest
from oracle import covariance

from tidewright.functions import families
from tidewright.functions.families import FAMILIES, AnalyticGradientError, Layout
from tidewright.functions.outcomes import CODES
from tidewright.operators import gradients, optimise
from tidewright.operators.engines import DenseEngine
from tidewright.operators.fitting import Axis, Objective, bounds, fit_batch

MODELS = ["white", "matern12", "matern32", "white + matern12", "white + matern32", "matern12 + matern32 + white", "matern12 + matern12 + white", "white(sigma=0.4) + matern12(rho=0.8)"]


def axis(n, jump=None):
    t = 2000 + np.arange(n) / 12
    if jump is not None:
        t[jump:] += 0.4
    return Axis(t, np.stack([np.ones(n), t - t.mean(), np.cos(2 * np.pi * t)], 1), 1)


@pytest.mark.parametrize("objective", ["ml", "reml"])
@pytest.mark.parametrize("model", MODELS)
def test_derivatives_against_richardson_differences(model, objective):
    """Gaps of one row, a gap of all rows, a longer step, and stretches long enough for the covariances to come to rest."""
    a = axis(260, jump=170)
    layout = Layout.of(model)
    y = np.random.default_rng(3).normal(size=(3, 260)) + np.sin(np.arange(260) / 5)
    y[0, 20:30] = np.nan
    y[:, 130] = np.nan
    y[1, ::9] = np.nan
    y[1, 30:] = np.random.default_rng(4).normal(size=230)
    fun = Objective(y, a, layout, objective, gradient="analytic")
    u = layout.unconstrained(np.array([[0.5 + 0.2 * k for k in range(len(layout.free))], [0.9 - 0.1 * k for k in range(len(layout.free))], [0.3] * len(layout.free)]))
    f, g = fun.with_gradient(u, np.arange(3))
    for i in range(3):
        want = gradients.richardson(lambda points, i=i: fun(points, np.full(len(points), i)), u[i])
        assert np.abs(g[i] - want).max() <= 1e-6 * max(1, abs(f[i]))
        assert f[i] == pytest.approx(fun(u[i : i + 1], np.array([i]))[0], rel=1e-12)


def test_rest_is_left_when_a_gap_or_a_step_comes(monkeypatch):
    """The same numbers with covariances that never rest, on rows that rest, are moved and rest again."""
    a, layout = axis(400, jump=300), Layout.of("matern12 + white")
    e = np.random.default_rng(5).normal(size=(4, 400, 1))
    e[2, 150] = e[1, 200:203] = np.nan
    theta = np.array([[0.5, 0.3, 0.4], [1.0, 0.2, 0.3], [0.7, 0.4, 0.6], [0.6, 0.1, 0.2]])
    rested = gradients.slopes(e, a, layout.kinds, theta)
    monkeypatch.setattr(gradients, "REST", -1.0)
    np.testing.assert_allclose(rested, gradients.slopes(e, a, layout.kinds, theta), rtol=1e-10, atol=1e-10)


@pytest.mark.parametrize("objective", ["ml", "reml"])
def test_curvature_and_fits_are_those_of_differences(objective):
    n, a = 120, axis(120)
    y = (np.linalg.cholesky(covariance(a.t, 0.8, 0.5, 0.3)) @ np.random.default_rng(7).normal(size=(n, 12))).T
    y[3, 10:40] = np.nan
    fast = fit_batch(y, a, "white + matern12", objective, 200)
    slow = fit_batch(y, a, "white + matern12", objective, 200, engine=DenseEngine())
    both = np.flatnonzero((fast["outcome"] == 0) & (slow["outcome"] == 0))
    assert len(both) >= 8
    np.testing.assert_allclose(fast["loglik"][both], slow["loglik"][both], atol=2e-5)
    np.testing.assert_allclose(fast["theta_err"][both], slow["theta_err"][both], rtol=2e-2)


def test_derivatives_that_are_wrong_or_missing(monkeypatch):
    right = FAMILIES["matern12"]
    wrong = dataclasses.replace(right, kind="crooked", dstationary=lambda s, r: [np.asarray(2.1 * s)[..., None, None], np.asarray(0 * r)[..., None, None]])
    none = dataclasses.replace(right, kind="silent", dstep=None)
    monkeypatch.setattr(families, "FAMILIES", FAMILIES)
    for f in (wrong, none):
        monkeypatch.setitem(FAMILIES, f.kind, f)
    assert gradients.verified("white + silent", "ml") == "finite_difference"
    assert gradients.verified("matern12(sigma=1, rho=1)", "ml") == "finite_difference"  # nothing to differentiate
    with pytest.raises(AnalyticGradientError, match="crooked"):
        gradients.verified("white + crooked", "ml")
    assert gradients.verified("white + matern12", "reml") == "analytic"


def rosenbrock(u, rows):
    x, y = u[:, 0], u[:, 1]
    return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.stack([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)], 1)


WIDE = np.full(2, -np.inf), np.full(2, np.inf)


def test_curved_valley_and_bounds():
    u = np.array([[-1.2, 1.0], [2.0, 2.0], [0.0, 0.0], [1.0, 1.0]])
    got = optimise.minimise(rosenbrock, u, np.arange(4), *WIDE, 200)
    np.testing.assert_allclose(got.u, 1, atol=1e-3)
    assert set(got.status) <= {optimise.GRADIENT, optimise.DECREASE} and got.iterations[3] == 0
    lo, hi = np.array([-2.0, -2.0]), np.array([0.5, 3.0])
    got = optimise.minimise(rosenbrock, u, np.arange(4), lo, hi, 200)
    np.testing.assert_allclose(got.u, [[0.5, 0.25]] * 4, atol=1e-4)
    corner = optimise.minimise(lambda u, r: ((u * u).sum(axis=1), 2 * u), np.array([[3.0, 4.0]]), np.zeros(1, int), np.array([1.0, 2.0]), np.array([5.0, 6.0]), 50)
    np.testing.assert_allclose(corner.u, [[1, 2]])
    assert corner.status[0] == optimise.GRADIENT


def test_steps_meet_the_strong_wolfe_conditions():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(40, 2)) * 2
    f, g = rosenbrock(u, None)
    d = -g
    new, fn, gn, found, _ = optimise.search(rosenbrock, u, f, g, d, np.arange(40), np.full(40, 1e-3), np.full(40, np.inf))
    assert found.all()
    a = ((new - u) * d).sum(axis=1) / (d * d).sum(axis=1)
    slope = (g * d).sum(axis=1)
    assert (fn <= f + optimise.SUFFICIENT * a * slope).all()
    assert (np.abs((gn * d).sum(axis=1)) <= -optimise.CURVATURE * slope * (1 + 1e-9)).mean() > 0.9


def test_every_termination_has_an_outcome():
    assert optimise.outcome_of(optimise.GRADIENT) == optimise.outcome_of(optimise.DECREASE) == CODES["OK"]
    assert optimise.outcome_of(optimise.CAP) == CODES["ITER_CAP_LARGE_GRAD"]
    assert optimise.outcome_of(optimise.NO_STEP) == CODES["TRUST_RADIUS_COLLAPSED"]
    assert optimise.outcome_of(optimise.NONFINITE) == CODES["NONFINITE_OBJECTIVE"]
    for status in (7, -1, 99):
        assert optimise.outcome_of(status) != CODES["OK"]
    run = lambda fun, u, n=50: optimise.minimise(fun, np.array([u]), np.zeros(1, int), *WIDE, n).status[0]
    assert run(rosenbrock, [-1.2, 1.0], 2) == optimise.CAP
    assert run(lambda u, r: (np.full(len(u), np.nan), np.full(u.shape, np.nan)), [0.0, 0.0]) == optimise.NONFINITE
    assert run(lambda u, r: (np.abs(u).sum(axis=1), np.full(u.shape, -1.0)), [0.0, 0.0]) == optimise.NO_STEP  # a gradient that points the wrong way
    assert run(lambda u, r: (1e9 + 1e-3 * (u * u).sum(axis=1), 2e-3 * u), [1.0, 1.0]) == optimise.DECREASE


def test_bounds_lie_just_beyond_the_limits():
    lo, hi = bounds(Layout.of("matern12 + white"))
    np.testing.assert_allclose(np.exp(lo), [1e-8, 1e-6, 1e-8], rtol=1e-5)
    assert (np.exp(lo) < [1e-8, 1e-6, 1e-8]).all() and (np.exp(hi) > [1e8, 1e6, 1e8]).all()


def test_the_filter_rests_and_moves_on_like_one_that_never_does(monkeypatch):
    from tidewright.operators.fitting import products

    a = axis(400, jump=300)
    y = np.random.default_rng(6).normal(size=(5, 400))
    y[2, 150] = y[1, 200:203] = y[4, 350] = np.nan
    y[:, 220] = np.nan
    for kinds, theta in ((("matern12", "white"), [0.5, 0.3, 0.4]), (("matern12", "matern32", "white"), [0.5, 0.2, 0.4, 0.3, 0.5])):
        th = np.tile(theta, (5, 1)) * np.linspace(0.8, 1.2, 5)[:, None]
        rested = products(y, a, kinds, th)
        with monkeypatch.context() as m:
            m.setattr(gradients, "REST", -1.0)
            for got, want in zip(rested, products(y, a, kinds, th), strict=True):
                np.testing.assert_allclose(got, want, rtol=1e-11, atol=1e-10)
        assert gradients.REST > 0
