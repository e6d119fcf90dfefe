"""Full maximum-likelihood fits of any candidate, as an Arrow map over packed series.

Spark deals packed series to tasks; a batch of series is evaluated together in numpy, with all the shifts that a gradient
needs as further rows of the batch.  What a task holds is one batch (``rows_per_batch``) times the axis.  The axis and its
design are as long as the time axis and go to the tasks with the function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.design import SignalError, columns_of, design
from tidewright.functions.families import FAMILIES, LIMITS, Layout
from tidewright.functions.outcomes import CODES
from tidewright.functions.transforms import delta_method
from tidewright.operators import gradients, optimise
from tidewright.operators.counting import pair_counts
from tidewright.operators.engines import Engine, KalmanEngine
from tidewright.operators.gls import ILL_LOG_CONDITION, RANK_LOG_CONDITION

EPS = np.finfo(float).eps
FIRST_STEP, SECOND_STEP, SLOPE_STEP = EPS ** (1 / 3), EPS**0.25, EPS ** (1 / 3)
RANK_TOLERANCE, HESSIAN_CONDITION, GRADIENT_TOLERANCE = np.sqrt(EPS), EPS**-0.5, 5e-5
SCHEMA = (
    "series_id bigint, m int, candidate string, loglik double, k double, n double, n_eff_bic double, n_eff_trend double, iterations int, outcome int, rung string,"
    " beta array<double>, beta_err array<double>, theta array<double>, theta_err array<double>, theta_u array<double>, beta_cov array<double>, theta_cov array<double>, objective string, engine string"
)


@dataclass(frozen=True)
class Axis:
    """Times and design, and where the trend column is (-1: none).

    The design is (time, column) if all series share it, or (series, time, column) if each has its own.
    """

    t: np.ndarray
    x: np.ndarray
    trend: int

    def of(self, rows: np.ndarray | slice) -> Axis:
        """The axis with the designs of some series."""
        return self if self.x.ndim == 2 else replace(self, x=self.x[rows])

    def at(self, i: int) -> np.ndarray:
        """The design at a time: a row for all series, or one for each."""
        return self.x[i] if self.x.ndim == 2 else self.x[:, i]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(representatives, group of each step): steps equal up to the tolerance share their matrices."""
        dt = np.diff(self.t)
        order = np.sort(dt)
        if not len(dt):
            return dt, np.empty(0, int)
        opens = np.concatenate(([True], np.diff(order) > 1e-9 * np.maximum(np.abs(order[1:]), np.abs(order[:-1]))))
        reps = order[opens]
        return reps, np.searchsorted(reps, dt, side="right") - 1


def products(y: np.ndarray, axis: Axis, kinds: tuple[str, ...], theta: np.ndarray, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, log determinant, whitened products of [y, X]) of each row; NaN in ``y`` is a gap.

    Rows go side by side through the filter, ``chunk`` at a time, so that what a step touches stays in the cache.
    """
    if len(y) > chunk:
        parts = [products(y[i : i + chunk], axis.of(slice(i, i + chunk)), kinds, theta[i : i + chunk], chunk) for i in range(0, len(y), chunk)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    b, steps = y.shape
    q = 1 + axis.x.shape[-1]
    r, parts, i = np.zeros(b), [], 0
    for kind in kinds:
        f = FAMILIES[kind]
        own = [theta[:, i + j] for j in range(len(f.params))]
        i += len(f.params)
        if f.dim:
            parts.append((f, own))
        else:
            r = r + own[0] ** 2
    there = np.isfinite(y)
    n = there.sum(axis=1)
    clean = np.where(there, y, 0.0)
    with np.errstate(all="ignore"):
        if not parts:
            w = np.where(there[:, :, None], np.concatenate((clean[:, :, None], np.broadcast_to(axis.x, (b, steps, q - 1))), axis=2), 0.0)
            return n, n * np.log(r), np.matmul(w.transpose(0, 2, 1), w) / r[:, None, None]
        whitened, logdet = filtered(clean.T.copy(), there.T, axis, parts, r)
    return n, logdet, np.matmul(whitened.transpose(1, 2, 0), whitened.transpose(1, 0, 2))


def filtered(y: np.ndarray, there: np.ndarray, axis: Axis, parts: list, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(innovations of [y, X] over their standard deviation, log determinant), time first.

    The state is block-diagonal in the terms; each entry of its mean and covariance is an array over the rows.
    """
    steps, b = y.shape
    q = 1 + axis.x.shape[-1]
    starts = np.cumsum([0, *(f.dim for f, _ in parts)])
    d = int(starts[-1])
    of = np.repeat(np.arange(len(parts)), [f.dim for f, _ in parts])
    inside = [range(starts[k], starts[k + 1]) for k in of]
    heads = starts[:-1].tolist()
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    entry = lambda ms, i, j: np.ascontiguousarray(np.broadcast_to(ms[of[i]][:, i - starts[of[i]], j - starts[of[i]]], b))
    begin = [f.stationary(*own) for f, own in parts]
    p = {(i, j): entry(begin, i, j) if of[i] == of[j] else np.zeros(b) for i, j in pairs}
    at = lambda i, j: p[(i, j) if i >= j else (j, i)]
    reps, group = axis.groups()
    moves = []
    for dt in reps:
        made = [f.step(*own, dt) for f, own in parts]
        moves.append(({(i, k): entry([m[0] for m in made], i, k) for i in range(d) for k in inside[i]}, {(i, j): entry([m[1] for m in made], i, j) for i, j in pairs if of[i] == of[j]}))
    x, step, alone = [np.zeros((b, q)) for _ in range(d)], np.empty((b, q)), d == len(parts)
    whitened, logdet = np.zeros((steps, b, q)), np.zeros(b)
    whole, some = there.all(axis=1), there.any(axis=1)
    rest, before, last, kept = False, None, -1, None
    for t in range(steps):
        if t:
            if rest and not (group[t - 1] == last and whole[t]):
                rest = False
                p = {(i, j): p[i, j] - kept[0][i] * kept[1][j] for i, j in pairs}  # of the last sample, which left it as predicted
            last = group[t - 1]
            f, noise = moves[last]
            if alone:
                for i in range(d):
                    x[i] *= f[i, i][:, None]
            else:
                x = [sum(f[i, k][:, None] * x[k] for k in inside[i]) for i in range(d)]
            if not rest:
                half = {(i, j): sum(f[i, k] * at(k, j) for k in inside[i]) for i in range(d) for j in range(d)}
                p = {(i, j): sum(half[i, k] * f[j, k] for k in inside[j]) for i, j in pairs}
                for ij, extra in noise.items():
                    p[ij] = p[ij] + extra
                # Covariances do not depend on the values; with equal steps and no gap they come to rest.
                if t % 8 == 0 and before is not None and whole[t]:
                    rest = all((np.abs(p[i, j] - before[i, j]) <= gradients.REST * np.sqrt(p[i, i] * p[j, j])).all() for i, j in pairs)
                before = p if t % 8 == 7 and whole[t] else None
                kept = None
        if not some[t]:
            continue
        if kept is None:
            ph = [sum(at(i, h) for h in heads) for i in range(d)]
            s = sum(ph[h] for h in heads) + r
            weight = 1 / s
            if not whole[t]:
                on = there[t]
                weight, s = np.where(on, weight, 0.0), np.where(on, s, 1.0)
            gain = [h * weight for h in ph]
            kept = gain, ph, np.sqrt(weight)[:, None], np.log(s)
            if not rest:
                p = {(i, j): p[i, j] - gain[i] * ph[j] for i, j in pairs}
        gain, _, scale, logs = kept
        v = whitened[t]
        v[:, 0] = y[t]
        v[:, 1:] = axis.at(t)
        for h in heads:
            v -= x[h]
        for i in range(d):
            x[i] += np.multiply(gain[i][:, None], v, out=step)
        v *= scale
        logdet += logs
    return whitened, logdet


def profile(n: np.ndarray, logdet: np.ndarray, a: np.ndarray, gram_logdet: np.ndarray, objective: str) -> dict[str, np.ndarray]:
    """The design profiled out: loglik, beta, its covariance and an outcome for each row."""
    g, y, k = a[:, 1:, 1:], a[:, 1:, 0], a.shape[1] - 1
    with np.errstate(all="ignore"):
        fine = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(logdet)
        safe = np.where(fine[:, None, None], g, np.eye(k))
        values, vectors = np.linalg.eigh(safe)
        log_condition = np.where(values[:, 0] > 0, (np.log(np.maximum(values[:, -1], 1e-300)) - np.log(np.maximum(values[:, 0], 1e-300))) / 2, np.inf)
        inverse = np.where(values > 0, 1 / values, 0)
        cov = np.einsum("bij,bj,bkj->bik", vectors, inverse, vectors)
        beta = np.einsum("bij,bj->bi", cov, y)
        reduction = (beta * y).sum(axis=1)
        loglik = -0.5 * (n * np.log(2 * np.pi) + logdet + a[:, 0, 0] - reduction)
        if objective == "reml":
            loglik = loglik + 0.5 * k * np.log(2 * np.pi) + 0.5 * gram_logdet - 0.5 * np.log(values).sum(axis=1)
        slack = np.sqrt(EPS) * np.maximum(np.abs(a[:, 0, 0]), 1)
        odd = (reduction < -slack) | (reduction > a[:, 0, 0] + slack)
    bad = ~fine | ~np.isfinite(loglik) | odd
    outcome = np.select([n == 0, log_condition > RANK_LOG_CONDITION, log_condition > ILL_LOG_CONDITION, bad], [CODES["INSUFFICIENT_DATA"], CODES["RANK_DEFICIENT_X"], CODES["ILL_CONDITIONED_X"], CODES["NONFINITE_OBJECTIVE"]], CODES["OK"])
    return {"loglik": loglik, "beta": beta, "cov": cov, "outcome": outcome}


class DesignError(ValueError):
    """Series, axis and design that do not fit together."""


def check_design(y: np.ndarray, axis: Axis) -> None:
    """Refuses series that are not as long as the axis, a design of another length, and design values that are no numbers."""
    if y.ndim != 2 or y.shape[1] != len(axis.t) or axis.x.shape[-2] != len(axis.t):
        raise DesignError(f"series of shape {y.shape} and a design of {axis.x.shape[-2]} rows do not fit an axis of {len(axis.t)} times")
    if axis.x.ndim == 3 and len(axis.x) != len(y):
        raise DesignError(f"{len(axis.x)} designs do not fit {len(y)} series")
    used = np.isfinite(y) if axis.x.ndim == 3 else np.isfinite(y).any(axis=0)
    if not np.isfinite(axis.x[used]).all():
        raise DesignError("the design has values that are no numbers where there are samples")


def design_ranks(there: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, condition, log determinant of the Gram matrix) of the design at the present samples, from singular values.

    Of a shared design each distinct pattern of gaps is decomposed once; rows that are not there are zeros, which change
    no singular value.
    """
    masks, of = np.unique(there, axis=0, return_inverse=True) if x.ndim == 2 else (there, np.arange(len(there)))
    cut = max(1, len(masks) // 256)
    own = np.array_split(x, cut) if x.ndim == 3 else [x] * cut
    values = np.concatenate([np.linalg.svd(np.where(m[:, :, None], d, 0.0), compute_uv=False) for m, d in zip(np.array_split(masks, cut), own, strict=True)])
    if values.shape[1] < x.shape[-1]:
        values = np.pad(values, ((0, 0), (0, x.shape[-1] - values.shape[1])))
    with np.errstate(divide="ignore", invalid="ignore"):
        rank = (values > RANK_TOLERANCE * values[:, :1]).sum(axis=1)
        condition = np.where(values[:, -1] > 0, values[:, 0] / values[:, -1], np.inf)
        logdet = 2 * np.log(values).sum(axis=1)
    of = of.ravel()
    return rank[of], condition[of], logdet[of]


def whitened_rank(gram: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """The rank of whitened Gram matrices (..., k, k), by their singular values."""
    values = np.linalg.svd(gram, compute_uv=False)
    return (values > tolerance * values[..., :1]).sum(axis=-1)


class Objective:
    """Minus the profiled log-likelihood over the unconstrained free parameters, infinite where it is not OK."""

    def __init__(self, y: np.ndarray, axis: Axis, model: str | tuple[str, ...] | Layout, objective: str, engine: Engine | None = None, gradient: str = "finite_difference"):
        check_design(y, axis)
        self.y, self.axis, self.layout, self.objective, self.engine = y, axis, Layout.of(model), objective, engine or KalmanEngine()
        self.gradient = gradient
        there = np.isfinite(y)
        if axis.x.ndim == 2:
            self.gram = np.einsum("bt,ti,tj->bij", there.astype(float), axis.x, axis.x)
        else:
            x = np.where(there[:, :, None], axis.x, 0.0)
            self.gram = np.matmul(x.transpose(0, 2, 1), x)
        self.rank, self.condition, self.gram_logdet = design_ranks(there, axis.x)

    def full(self, u: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
        with np.errstate(over="ignore"):
            theta = self.layout.hydrate(self.layout.natural(u))
            return profile(*self.engine.score(self.y[rows], self.axis.of(rows), self.layout.kinds, theta), self.gram_logdet[rows], self.objective)

    def __call__(self, u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        got = self.full(u, rows)
        return np.where(got["outcome"] == 0, -got["loglik"], np.inf)

    def with_gradient(self, u: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value and gradient: derivatives through the filter, or central differences."""
        if self.gradient == "analytic":
            return self.with_derivatives(u, rows)
        p = u.shape[1]
        shift = np.concatenate((np.zeros((1, p)), np.eye(p) * FIRST_STEP, -np.eye(p) * FIRST_STEP))
        f = self((u[:, None, :] + shift).reshape(-1, p), np.repeat(rows, 2 * p + 1)).reshape(len(u), -1)
        with np.errstate(invalid="ignore"):
            return f[:, 0], (f[:, 1 : p + 1] - f[:, p + 1 :]) / (2 * FIRST_STEP)

    def with_derivatives(self, u: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self.full(u, rows)
        ok = np.flatnonzero(got["outcome"] == 0)
        f, g = np.where(got["outcome"] == 0, -got["loglik"], np.inf), np.full(u.shape, np.nan)
        if len(ok):
            at = rows[ok]
            x = np.broadcast_to(self.axis.of(at).x, (len(at), *self.axis.x.shape[-2:]))
            columns = [self.y[at] - np.matmul(x, got["beta"][ok][:, :, None])[:, :, 0]]
            if self.objective == "reml":  # the columns of the design, with a whitened Gram matrix of one
                root = np.linalg.cholesky(got["cov"][ok])
                columns += list(np.matmul(x, root).transpose(2, 0, 1))
            theta = self.layout.hydrate(self.layout.natural(u[ok]))
            d = gradients.slopes(np.stack(columns, axis=2), self.axis, self.layout.kinds, theta)[:, self.layout.free]
            with np.errstate(all="ignore"):
                g[ok] = 0.5 * d * self.layout.slopes(u[ok])
        return f, g

    def hessian(self, u: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Second derivatives: differences of the gradient where that is exact, else of the value."""
        p = u.shape[1]
        if self.gradient == "analytic":
            e = np.eye(p) * SLOPE_STEP
            shift = np.concatenate((e, -e))
            _, g = self.with_derivatives((u[:, None, :] + shift).reshape(-1, p), np.repeat(rows, 2 * p))
            g = g.reshape(len(u), 2 * p, p)
            out = (g[:, :p] - g[:, p:]) / (2 * SLOPE_STEP)
            return (out + out.transpose(0, 2, 1)) / 2
        h = SECOND_STEP
        e = np.eye(p) * h
        pairs = [(i, j) for i in range(p) for j in range(i + 1)]
        shift = np.concatenate([np.stack([e[i] + e[j], e[i] - e[j], -e[i] + e[j], -e[i] - e[j]]) for i, j in pairs])
        f = self((u[:, None, :] + shift).reshape(-1, p), np.repeat(rows, len(shift))).reshape(len(u), len(pairs), 4)
        out = np.zeros((len(u), p, p))
        with np.errstate(invalid="ignore"):
            for k, (i, j) in enumerate(pairs):
                out[:, i, j] = out[:, j, i] = (f[:, k, 0] - f[:, k, 1] - f[:, k, 2] + f[:, k, 3]) / (4 * h * h)
        return out


def bounds(layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Limits of the free parameters as they are fitted, a little beyond those at which a fit is not believed."""
    wide = 1e-6
    limits = [LIMITS.get(name, (-np.inf, np.inf)) for _, name in layout.free_names]
    ends = []
    for side in (0, 1):
        natural = np.array([[x[side] for x in limits]])
        with np.errstate(all="ignore"):
            u = layout.unconstrained(natural)[0] if limits else np.empty(0)
        ends.append(np.where(np.isfinite(u), u + (wide if side else -wide), np.inf if side else -np.inf))
    return ends[0], ends[1]


def as_point(u: np.ndarray) -> np.ndarray:
    """A point to differentiate at: one vector of numbers."""
    point = np.asarray(u, float)
    if point.ndim != 1:
        raise ValueError(f"the point has to be one vector, got an array of shape {point.shape}")
    return point


def starting_values(y: np.ndarray, t: np.ndarray, model: str | tuple[str, ...] | Layout) -> tuple[np.ndarray, np.ndarray]:
    """Starting values of the free parameters, unconstrained, and the rung that they come from: 0 moments, 1 clipped, 2 default."""
    layout = Layout.of(model)
    there = np.isfinite(y)
    n = np.maximum(there.sum(axis=1), 1)
    c = np.where(there, y - (np.where(there, y, 0).sum(axis=1) / n)[:, None], 0.0)
    var = (c * c).sum(axis=1) / n
    some = (there.sum(axis=1) > 1) & (var > 0)
    with np.errstate(all="ignore"):
        r1 = (c[:, 1:] * c[:, :-1]).sum(axis=1) / (c * c).sum(axis=1)
        related = some & (r1 > 0) & (r1 < 1)
        natural = {"sigma": np.where(some, np.sqrt(var), 1.0), "rho": np.where(related, -(np.median(np.diff(t)) if len(t) > 1 else 1.0) / np.log(r1), 1.0)}
    rung = np.where(some & (related | (not any(name == "rho" for _, name in layout.free_names))), 0, 2)
    out = []
    for _, name in layout.free_names:
        at = natural.get(name, np.ones(len(y)))
        v = np.clip(at, *LIMITS.get(name, (-np.inf, np.inf)))
        rung = np.where((v != at) & (rung == 0), 1, rung)
        out.append(v)
    return (layout.unconstrained(np.stack(out, axis=1)) if out else np.zeros((len(y), 0))), rung


def correlations(kinds: tuple[str, ...], theta: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, float]:
    """(autocorrelation at lags, variance) of one fitted model; each family knows its own autocovariance."""
    total, i = np.zeros(np.shape(lag)), 0
    var = 0.0
    for kind in kinds:
        f = FAMILIES[kind]
        if f.covariance is None:
            raise ValueError(f"the family {kind!r} has no autocovariance in numpy, so effective sizes are unknown")
        own = theta[i : i + len(f.params)]
        total, var = total + f.covariance(lag, *own), var + float(f.covariance(np.zeros(1), *own)[0])
        i += len(f.params)
    return total / var, var


def sum_of_variances(kinds: tuple[str, ...], theta: np.ndarray) -> np.ndarray:
    """The variance of each row's model."""
    return np.array([correlations(kinds, row, np.zeros(1))[1] for row in theta])


def equal_steps(t: np.ndarray) -> bool:
    dt = np.diff(t)
    return len(dt) > 0 and bool(np.ptp(dt) <= 1e-9 * np.abs(dt).max())


def squared_correlations(on: np.ndarray, t: np.ndarray, kinds: tuple[str, ...], theta: np.ndarray, block: int = 512) -> float:
    """The sum of squared correlations over all pairs of present samples.

    On an axis of equal steps pairs are counted by lag; on any other the pairs are taken in blocks, so memory is that of a
    block of rows.
    """
    if equal_steps(t):
        rho, _ = correlations(kinds, theta, np.arange(len(t)) * (t[-1] - t[0]) / (len(t) - 1))
        pairs = pair_counts(on)
        return float((pairs * rho * rho).sum() * 2 - pairs[0] * rho[0] ** 2)
    at = np.flatnonzero(on)
    total = 0.0
    for lo in range(0, len(at), block):
        rho, _ = correlations(kinds, theta, t[at[lo : lo + block]][:, None] - t[at][None, :])
        total += float((rho * rho).sum())
    return total


def all_squared_correlations(on: np.ndarray, t: np.ndarray, kinds: tuple[str, ...], theta: np.ndarray) -> np.ndarray:
    """The same for each row; on an axis of equal steps the pairs of a pattern of gaps are counted once."""
    if not equal_steps(t):
        return np.array([squared_correlations(o, t, kinds, th) for o, th in zip(on, theta, strict=True)])
    masks, of = np.unique(on, axis=0, return_inverse=True)
    pairs = np.concatenate([pair_counts(m) for m in np.array_split(masks, max(1, len(masks) // 64))])
    lag = np.arange(len(t)) * (t[-1] - t[0]) / (len(t) - 1)
    out = np.empty(len(on))
    for i, (k, th) in enumerate(zip(of.ravel(), theta, strict=True)):
        squares = correlations(kinds, th, lag)[0] ** 2
        out[i] = 2 * pairs[k] @ squares - pairs[k][0] * squares[0]
    return out


def fit_batch(y: np.ndarray, axis: Axis, model: str | tuple[str, ...] | Layout, objective: str, max_iter: int, x0: np.ndarray | None = None, engine: Engine | None = None) -> dict[str, np.ndarray]:
    """Fits of all rows of ``y`` (series by time, NaN for gaps).

    ``x0`` holds unconstrained starting values, a row for each series; rows with a NaN start from their own moments.
    """
    layout = Layout.of(model)
    b, k = len(y), axis.x.shape[-1]
    p = len(layout.free)
    exact = engine is None or isinstance(engine, KalmanEngine)
    fun = Objective(y, axis, layout, objective, engine, gradients.verified(layout, objective) if exact else "finite_difference")
    n_obs = np.isfinite(y).sum(axis=1)
    u, rung = starting_values(y, axis.t, layout)
    if x0 is not None:
        if np.shape(x0) != (b, p):
            raise ValueError(f"starting values of shape {np.shape(x0)} do not fit {b} series with {p} free parameters")
        warm = np.isfinite(x0).all(axis=1)
        u, rung = np.where(warm[:, None], x0, u), np.where(warm, 3, rung)
    outcome = np.select([n_obs == 0, fun.rank < k], [CODES["INSUFFICIENT_DATA"], CODES["RANK_DEFICIENT_X"]], CODES["OK"])
    iterations, curvature = np.zeros(b, int), np.full((b, p, p), np.nan)
    rows = np.flatnonzero(outcome == 0)
    if len(rows) and not p:
        outcome[rows] = fun.full(u[rows], rows)["outcome"]
    elif len(rows):
        found = optimise.minimise(fun.with_gradient, u[rows], rows, *bounds(layout), max_iter)
        got, f, g, status = found.u, found.f, found.g, found.status
        u[rows], iterations[rows] = got, found.iterations
        cause = fun.full(got, rows)["outcome"]
        theta = layout.natural(got)
        limits = [LIMITS.get(name, (-np.inf, np.inf)) for _, name in layout.free_names]
        limit = np.any([(theta[:, j] <= lo) | (theta[:, j] >= hi) for j, (lo, hi) in enumerate(limits)], axis=0)
        small = np.linalg.norm(np.nan_to_num(g, nan=np.inf), axis=1) < GRADIENT_TOLERANCE * np.maximum(np.abs(f), 1)
        ended = np.array([optimise.outcome_of(x) for x in status])
        ended = np.where((status == optimise.CAP) & small, CODES["ITER_CAP_SMALL_GRAD"], ended)
        outcome[rows] = np.select([~np.isfinite(f), limit], [np.where(cause > 0, cause, CODES["NONFINITE_OBJECTIVE"]), CODES["DIAGNOSTIC_LIMIT"]], ended)
        # Curvature means something at an optimum only.
        at = np.flatnonzero(outcome[rows] == 0)
        if len(at):
            hessian = fun.hessian(got[at], rows[at])
            sound = np.isfinite(hessian).all(axis=(1, 2))
            condition = np.full(len(at), np.inf)
            condition[sound] = np.linalg.cond(hessian[sound])
            outcome[rows[at[~(condition <= HESSIAN_CONDITION)]]] = CODES["DEGENERATE_HESSIAN"]
            curvature[rows[at]] = hessian
    ok = np.flatnonzero(outcome == 0)
    none = lambda *shape: np.full((b, *shape), np.nan)
    out = {"outcome": outcome, "iterations": iterations, "rung": rung, "theta_u": u, "loglik": none(), "k": none(), "n": none(), "n_eff_bic": none(), "n_eff_trend": none(), "beta": none(k), "beta_err": none(k), "theta": none(p), "theta_err": none(p), "beta_cov": none(k * (k + 1) // 2), "theta_cov": none(p * (p + 1) // 2)}
    if len(ok):
        last = fun.full(u[ok], ok)
        theta = layout.natural(u[ok])
        out["loglik"][ok], out["beta"][ok] = last["loglik"], last["beta"]
        out["beta_err"][ok] = np.sqrt(np.maximum(np.einsum("bii->bi", last["cov"]), 0))
        out["beta_cov"][ok] = last["cov"][:, *np.tril_indices(k)]
        out["theta"][ok] = theta
        if p:
            cov = delta_method(np.linalg.inv(curvature[ok]), layout.slopes(u[ok]))
            out["theta_err"][ok] = np.sqrt(np.maximum(np.einsum("bii->bi", cov), 0))
            out["theta_cov"][ok] = cov[:, *np.tril_indices(p)]
        reml = objective == "reml"
        out["k"][ok], out["n"][ok] = p + (0 if reml else fun.rank[ok]), n_obs[ok] - (fun.rank[ok] if reml else 0)
        whole = layout.hydrate(theta)
        out["n_eff_bic"][ok] = n_obs[ok] ** 2 / all_squared_correlations(np.isfinite(y[ok]), axis.t, layout.kinds, whole)
        if axis.trend >= 0:
            var = sum_of_variances(layout.kinds, whole)
            white = var * np.linalg.inv(fun.gram[ok])[:, axis.trend, axis.trend]
            out["n_eff_trend"][ok] = np.clip(n_obs[ok] * white / last["cov"][:, axis.trend, axis.trend], 1, n_obs[ok])
    return out


def loglik(y: np.ndarray, axis: Axis, model: str | tuple[str, ...] | Layout, theta: np.ndarray, objective: str = "ml", engine: Engine | None = None) -> np.ndarray:
    """The profiled log-likelihood of each row at natural free parameters; -inf where it is not OK."""
    layout = Layout.of(model)
    return unconstrained_loglik(y, axis, layout, layout.unconstrained(np.atleast_2d(theta)), objective, engine)


def unconstrained_loglik(y: np.ndarray, axis: Axis, model: str | tuple[str, ...] | Layout, u: np.ndarray, objective: str = "ml", engine: Engine | None = None) -> np.ndarray:
    return -Objective(y, axis, model, objective, engine)(np.broadcast_to(u, (len(y), np.shape(u)[-1])), np.arange(len(y)))


MOST_TIMES = 1 << 20


def planned(axis_df: DataFrame, terms: list[str], most: int = MOST_TIMES) -> Axis:
    """The shared axis with its design; its length is that of the time axis, and an axis of more than ``most`` times is refused.

    A term ``regressor:name`` takes the column ``name`` of ``axis_df``, which has a number at each time.
    """
    if missing := [c for c in columns_of(terms) if c not in axis_df.columns]:
        raise SignalError(f"the axis has no column {missing[0]!r} for the regressor of this name")
    mean = axis_df.agg(F.avg("t").alias("mean_t"))
    every = axis_df.crossJoin(F.broadcast(mean))
    rows = every.select("i", "t", F.array(*design(terms, F.col("t"), F.col("mean_t"))).alias("x")).orderBy("i").limit(most + 1).collect()
    if len(rows) > most:
        raise SignalError(f"the axis has more than {most} times; series that share no axis are not fitted together")
    x = np.array([[np.nan if v is None else v for v in r.x] for r in rows], float).reshape(len(rows), -1)
    if not np.isfinite(x).all():
        raise SignalError("a design column is no number at some time")
    names = column_terms(terms)
    return Axis(np.array([r.t for r in rows]), x, names.index("trend") if "trend" in names else -1)


def column_terms(terms: list[str]) -> list[str]:
    """The term that each design column comes from; a harmonic has two columns."""
    return [name for term in terms for name in ([term] * 2 if term.split(":")[0].strip() in ("annual", "semiannual", "harmonic") else [term])]


def k_beta(terms: list[str]) -> int:
    """How many design columns there are: columns, not terms."""
    return len(column_terms(terms))


RUNGS = ("MOMENT", "CLIPPED", "DEFAULT", "WARM_START")


def fit(packed: DataFrame, axis: Axis, candidates: list[str], objective: str = "ml", max_iter: int = 200, rows_per_batch: int = 1024, x0: DataFrame | None = None, engine: Engine | None = None, carry: tuple[str, ...] = (), fields: tuple[str, ...] = ()) -> DataFrame:
    """One row per series and candidate; values are NULL unless the outcome is OK.

    ``beta_cov`` and ``theta_cov`` are lower triangles, row by row.  Columns named in ``carry`` go with their series.
    ``fields`` are numbers that each sample has beside its value: further design columns, which differ from series to
    series; a sample that lacks one of them is a gap.

    ``x0`` (series_id, candidate, theta_u) gives unconstrained starting values, such as those of a former fit; ``engine``
    evaluates the likelihood in place of the filter.  Families that the caller has registered go to the workers with them.
    """
    engine = engine or KalmanEngine()
    layouts = [Layout.of(c) for c in candidates]
    known = {k: FAMILIES[k] for one in layouts for k in one.kinds}
    names = [*(x.split()[0] for x in SCHEMA.replace(", ", ",").split(",")), *carry]
    schema = ", ".join([SCHEMA, *(f"{c} {packed.schema[c].dataType.simpleString()}" for c in carry)])
    if isinstance(engine, KalmanEngine):
        for layout in layouts:  # derivatives that a registered family claims are checked here first
            gradients.verified(layout, objective)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewright.functions import families  # the worker's own registry, not a copy of the caller's

        families.FAMILIES.update({k: f for k, f in known.items() if k not in families.FAMILIES})
        for whole in batches:
            for at in range(0, whole.num_rows, rows_per_batch):
                batch = whole.slice(at, rows_per_batch)
                samples, n = batch.column(1), batch.num_rows
                flat = samples.flatten()
                row = np.repeat(np.arange(n), samples.value_lengths().fill_null(0).to_numpy())
                y = np.full((n, len(axis.t)), np.nan)
                at_time = flat.field("i").to_numpy()
                y[row, at_time] = flat.field("v").to_numpy(zero_copy_only=False)
                own = axis
                if fields:
                    x = np.full((n, len(axis.t), len(fields)), np.nan)
                    for f, name in enumerate(fields):
                        x[row, at_time, f] = flat.field(name).to_numpy(zero_copy_only=False)
                    lacking = ~np.isfinite(x).all(axis=2)
                    y[lacking], x[lacking] = np.nan, 0.0
                    own = Axis(axis.t, np.concatenate((np.broadcast_to(axis.x, (n, *axis.x.shape)), x), axis=2), axis.trend)
                warm = [dict((s["candidate"], s["theta_u"]) for s in w or []) for w in batch.column(2).to_pylist()]
                for m, (text, layout) in enumerate(zip(candidates, layouts, strict=True)):
                    none = [np.nan] * len(layout.free)
                    start = np.array([w.get(text) or none for w in warm], float).reshape(n, -1) if any(text in w for w in warm) else None
                    got = fit_batch(y, own, layout, objective, max_iter, start, engine)
                    number = lambda x: pa.array(x, pa.float64(), from_pandas=True)
                    lists = lambda x: pa.array([None if np.isnan(r).any() else r.tolist() for r in x], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(np.full(n, m, np.int32)), pa.array([text] * n), *(number(got[c]) for c in ("loglik", "k", "n", "n_eff_bic", "n_eff_trend")), pa.array(got["iterations"].astype(np.int32)), pa.array(got["outcome"].astype(np.int32)),
                         pa.array([RUNGS[i] for i in got["rung"]]), *(lists(got[c]) for c in ("beta", "beta_err", "theta", "theta_err", "theta_u", "beta_cov", "theta_cov")), pa.array([objective] * n), pa.array([engine.engine_id] * n), *batch.columns[3:]],
                        names=names,
                    )

    series = packed.select(F.col("series_id").cast("long").alias("series_id"), F.transform("samples", lambda s: F.struct(s["i"].cast("int").alias("i"), s["v"].alias("v"), *(s[f].cast("double").alias(f) for f in fields))).alias("samples"), *carry)
    if x0 is None:
        series = series.withColumn("warm", F.lit(None).cast("array<struct<candidate:string,theta_u:array<double>>>"))
    else:
        warm = x0.where("theta_u is not null").groupBy(F.col("series_id").cast("long").alias("series_id")).agg(F.collect_list(F.struct("candidate", F.col("theta_u").cast("array<double>").alias("theta_u"))).alias("warm"))
        series = series.join(warm, "series_id", "left_outer")
    return series.select("series_id", "samples", "warm", *carry).mapInArrow(run, schema)
