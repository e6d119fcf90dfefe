"""Bounded limited-memory quasi-Newton steps for many problems side by side.

Every row of a batch is a problem of its own.  Directions come from a two-loop recursion over the last ``memory`` steps,
on the coordinates that no bound holds; a step is searched until the strong Wolfe conditions hold and never leaves the
bounds.  All rows that still move are evaluated together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tidewright.functions.outcomes import CODES

GRADIENT, DECREASE, CAP, NO_STEP, NONFINITE = range(5)
#: Why a row stopped, as an outcome; a capped row is looked at once more, for the size of its gradient.
OUTCOMES = {GRADIENT: "OK", DECREASE: "OK", CAP: "ITER_CAP_LARGE_GRAD", NO_STEP: "TRUST_RADIUS_COLLAPSED", NONFINITE: "NONFINITE_OBJECTIVE"}
SUFFICIENT, CURVATURE = 1e-4, 0.9
GRADIENT_LIMIT, DECREASE_LIMIT = 1e-5, 2.22e-9

Fun = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def outcome_of(status: int) -> int:
    """The outcome code of a termination; one that is not known counts as a failure, never as a success."""
    return CODES[OUTCOMES.get(int(status), "NONFINITE_OBJECTIVE")]


@dataclass
class Found:
    """Where each row stopped, why, after how many steps, and how many evaluations of value and gradient it took."""

    u: np.ndarray
    f: np.ndarray
    g: np.ndarray
    iterations: np.ndarray
    status: np.ndarray
    evaluations: np.ndarray


def held(u: np.ndarray, g: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Coordinates at a bound that the gradient pushes against."""
    return ((u <= lo) & (g > 0)) | ((u >= hi) & (g < 0))


def two_loop(g: np.ndarray, s: list[np.ndarray], y: list[np.ndarray], use: list[np.ndarray]) -> np.ndarray:
    """Minus the inverse curvature of the remembered steps times ``g``; rows take only the steps that are theirs (``use``)."""
    q, alphas = g.copy(), []
    scale = np.ones(len(g))
    for a, b, on in zip(reversed(s), reversed(y), reversed(use), strict=True):
        sy = np.where(on, (a * b).sum(axis=1), 1.0)
        alpha = np.where(on, (a * q).sum(axis=1) / sy, 0.0)
        q -= alpha[:, None] * b
        alphas.append((alpha, sy))
    for a, b, on in zip(s, y, use, strict=True):  # the latest step of a row gives the scale
        scale = np.where(on, (a * b).sum(axis=1) / np.where(on, (b * b).sum(axis=1), 1.0), scale)
    q *= scale[:, None]
    for a, b, on, (alpha, sy) in zip(s, y, use, reversed(alphas), strict=True):
        beta = np.where(on, (b * q).sum(axis=1) / sy, 0.0)
        q += (alpha - beta)[:, None] * a
    return -q


def search(fun: Fun, u: np.ndarray, f0: np.ndarray, g0: np.ndarray, d: np.ndarray, rows: np.ndarray, first: np.ndarray, limit: np.ndarray, most: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, f, g, found, evaluations) after a step along ``d`` that meets the strong Wolfe conditions, or at least decreases.

    Each row first widens its step until an interval holds a good one, then narrows the interval by a parabola; at
    ``limit``, where a bound is met, a step that decreases enough is taken as it is.
    """
    b = len(u)
    slope0 = (d * g0).sum(axis=1)
    a = np.minimum(first, limit)
    lo, f_lo, s_lo = np.zeros(b), f0.copy(), slope0.copy()
    hi, f_hi = np.full(b, np.inf), np.full(b, np.inf)
    best_u, best_f, best_g, found = u.copy(), f0.copy(), g0.copy(), np.zeros(b, bool)
    evaluations, live = np.zeros(b, int), np.arange(b)
    for _ in range(most):
        at = u[live] + a[live, None] * d[live]
        f, g = fun(at, rows[live])
        evaluations[live] += 1
        with np.errstate(invalid="ignore"):
            slope = (d[live] * g).sum(axis=1)
            fine = np.isfinite(f) & np.isfinite(g).all(axis=1)
            enough = fine & (f <= f0[live] + SUFFICIENT * a[live] * slope0[live])
            good = enough & ((np.abs(slope) <= -CURVATURE * slope0[live]) | ((a[live] >= limit[live]) & (slope < 0)))
            better = enough & (f < f_lo[live])
        take = good | (enough & (f < best_f[live]))
        best_u[live[take]], best_f[live[take]], best_g[live[take]], found[live[take]] = at[take], f[take], g[take], True
        open_ = ~good
        worse = open_ & ~better
        hi[live[worse]], f_hi[live[worse]] = a[live[worse]], np.where(np.isfinite(f[worse]), f[worse], np.inf)
        on = open_ & better
        i = live[on]
        back = slope[on] * (np.where(np.isfinite(hi[i]), hi[i], np.inf) - lo[i]) >= 0  # the minimum lies towards the former end
        hi[i], f_hi[i] = np.where(back, lo[i], hi[i]), np.where(back, f_lo[i], f_hi[i])
        lo[i], f_lo[i], s_lo[i] = a[i], f[on], slope[on]
        live = live[open_]
        if not len(live):
            break
        width = hi[live] - lo[live]
        closed = np.isfinite(width)
        with np.errstate(all="ignore"):
            bend = f_hi[live] - f_lo[live] - s_lo[live] * width
            share = np.where(closed & np.isfinite(bend) & (bend > 0), -s_lo[live] * width / (2 * bend), 0.5)
        share = np.clip(np.where(np.isfinite(share), share, 0.5), 0.1, 0.9)
        a[live] = np.where(closed, lo[live] + share * np.where(closed, width, 0.0), np.minimum(2.5 * lo[live], limit[live]))
        live = live[~(closed & (np.abs(width) <= 1e-14 * np.maximum(np.abs(lo[live]), 1e-3)))]
        if not len(live):
            break
    return best_u, best_f, best_g, found, evaluations


def minimise(fun: Fun, u: np.ndarray, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, max_iter: int, memory: int = 10) -> Found:
    """Minimises ``fun`` (points, rows to values, gradients) from each row of ``u`` within the bounds of the coordinates."""
    b, p = u.shape
    u = np.clip(u, lo, hi)
    status, iterations = np.full(b, -1), np.zeros(b, int)
    f, g = fun(u, rows)
    evaluations = np.ones(b, int)
    s: list[np.ndarray] = []
    y: list[np.ndarray] = []
    use: list[np.ndarray] = []
    status[~np.isfinite(f) | ~np.isfinite(g).all(axis=1)] = NONFINITE
    free_size = lambda i: np.abs(np.where(held(u[i], g[i], lo, hi), 0.0, g[i])).max(axis=1, initial=0.0)
    status[(status < 0) & (free_size(np.arange(b)) <= GRADIENT_LIMIT)] = GRADIENT
    for _ in range(max_iter):
        live = np.flatnonzero(status < 0)
        if not len(live):
            break
        fixed = held(u[live], g[live], lo, hi)
        own = np.where(fixed, 0.0, g[live])
        d = np.where(fixed, 0.0, two_loop(own, [np.where(fixed, 0.0, x[live]) for x in s], [np.where(fixed, 0.0, x[live]) for x in y], [x[live] & ((np.where(fixed, 0.0, a[live]) * b_[live]).sum(axis=1) > 0) for x, a, b_ in zip(use, s, y, strict=True)]))
        d[((u[live] <= lo) & (d < 0)) | ((u[live] >= hi) & (d > 0))] = 0.0
        with np.errstate(invalid="ignore"):
            turn = ~((d * own).sum(axis=1) < 0)
        d[turn] = -own[turn]
        size = np.linalg.norm(d, axis=1)
        fresh = turn | ~np.any([x[live] for x in use], axis=0) if use else np.ones(len(live), bool)
        first = np.where(fresh, np.minimum(1, 1 / np.maximum(size, 1e-300)), np.minimum(1, 5 / np.maximum(size, 1e-300)))
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(d > 0, (hi - u[live]) / d, np.where(d < 0, (lo - u[live]) / d, np.inf))
        limit = room.min(axis=1)
        new_u, new_f, new_g, found, spent = search(fun, u[live], f[live], g[live], d, rows[live], first, limit)
        new_u = np.clip(new_u, lo, hi)
        evaluations[live] += spent
        # A row whose remembered steps led nowhere starts afresh once, down its gradient.
        stuck = live[~found]
        again = stuck[np.any([x[stuck] for x in use], axis=0)] if use else stuck[:0]
        for x in use:
            x[again] = False
        status[np.setdiff1d(stuck, again)] = NO_STEP
        moved = live[found]
        if not len(moved):
            continue
        iterations[moved] += 1
        step, change = np.zeros((b, p)), np.zeros((b, p))
        step[moved], change[moved] = new_u[found] - u[moved], new_g[found] - g[moved]
        sound = np.zeros(b, bool)
        sound[moved] = (step[moved] * change[moved]).sum(axis=1) > 1e-10 * np.linalg.norm(step[moved], axis=1) * np.linalg.norm(change[moved], axis=1)
        s, y, use = [*s, step][-memory:], [*y, change][-memory:], [*use, sound][-memory:]
        drop = f[moved] - new_f[found]
        settled = drop <= DECREASE_LIMIT * np.maximum(np.maximum(np.abs(f[moved]), np.abs(new_f[found])), 1)
        u[moved], f[moved], g[moved] = new_u[found], new_f[found], new_g[found]
        status[moved[settled]] = DECREASE
        status[moved[free_size(moved) <= GRADIENT_LIMIT]] = GRADIENT
    status[status < 0] = CAP
    return Found(u, f, g, iterations, status, evaluations)
