"""Derivatives of the profiled likelihood, carried through the filter beside mean and covariance.

At the profiled coefficients a likelihood does not change with them to first order, so its derivative is that of the
residual series alone: one column goes through the filter instead of the whole design.  The restricted likelihood adds
the columns of the design, scaled so that their whitened Gram matrix is the identity.  For each parameter the tangents
of the state's mean and covariance are arrays over (parameter, row); a pass costs little more than one of the filter.

Derivatives are used only after they have been compared with Richardson differences of the likelihood itself.
"""

from __future__ import annotations

from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np

from tidewright.functions.families import FAMILIES, AnalyticGradientError, Family, Layout

if TYPE_CHECKING:
    from tidewright.operators.fitting import Axis

#: A covariance that moves by less than this share of itself in a step has come to rest.
REST = 1e-14
#: Largest difference from Richardson differences, relative to the likelihood's size, that derivatives may have.
AGREEMENT = 1e-6


def differentiable(layout: Layout) -> bool:
    """Whether every term knows its derivatives; a term without a state has none to know."""
    return all(not f.dim or (f.dstep is not None and f.dstationary is not None) for f in (FAMILIES[k] for k in layout.kinds))


class Tangents:
    """The matrices of a candidate's terms at some parameters, entry by entry over the rows.

    What depends on parameters is stacked: the value first, then its derivative by each parameter.  Transitions keep the
    derivatives of their own term's parameters only, and of those only the ones that are not zero.
    """

    def __init__(self, kinds: tuple[str, ...], theta: np.ndarray):
        self.b, self.p = theta.shape
        self.terms: list[tuple[Family, list[np.ndarray], range]] = []
        self.r = np.zeros((1 + self.p, self.b))
        self.of: list[int] = []
        at = 0
        for kind in kinds:
            f = FAMILIES[kind]
            own = [theta[:, at + j] for j in range(len(f.params))]
            if f.dim:
                self.of += [len(self.terms)] * f.dim
                self.terms.append((f, own, range(at, at + len(own))))
            else:
                self.r[0] += own[0] ** 2
                self.r[1 + at] = 2 * own[0]
            at += len(f.params)
        self.d = len(self.of)
        self.start = [self.of.index(k) for k in self.of]
        self.inside = [[j for j in range(self.d) if self.of[j] == k] for k in self.of]
        self.heads = sorted({self.of.index(k) for k in self.of})
        self.pairs = [(i, j) for i in range(self.d) for j in range(i + 1)]
        self.blocks = [(i, j) for i, j in self.pairs if self.of[i] == self.of[j]]

    def entry(self, m: np.ndarray, i: int, j: int) -> np.ndarray:
        return np.ascontiguousarray(np.broadcast_to(m[:, i - self.start[i], j - self.start[i]], self.b))

    def stacked(self, made: list[np.ndarray], by: list[list[np.ndarray]], i: int, j: int) -> np.ndarray:
        out, k = np.zeros((1 + self.p, self.b)), self.of[i]
        out[0] = self.entry(made[k], i, j)
        for at, m in zip(self.terms[k][2], by[k], strict=True):
            out[1 + at] = self.entry(m, i, j)
        return out

    def begin(self) -> dict:
        made, by = [f.stationary(*own) for f, own, _ in self.terms], [f.dstationary(*own) for f, own, _ in self.terms]
        return {ij: self.stacked(made, by, *ij) if ij in self.blocks else np.zeros((1 + self.p, self.b)) for ij in self.pairs}

    def move(self, dt: float) -> tuple[dict, dict, dict]:
        """Transition, its derivatives that are not zero, and the stacked process noise for a step."""
        made, by = [f.step(*own, dt) for f, own, _ in self.terms], [f.dstep(*own, dt) for f, own, _ in self.terms]
        f = {(i, k): self.entry(made[self.of[i]][0], i, k) for i in range(self.d) for k in self.inside[i]}
        df = {}
        for i, k in f:
            each = [(1 + at, self.entry(m, i, k)) for at, m in zip(self.terms[self.of[i]][2], by[self.of[i]][0], strict=True)]
            df[i, k] = [(at, g) for at, g in each if g.any()]
        return f, df, {ij: self.stacked([m[1] for m in made], [m[1] for m in by], *ij) for ij in self.blocks}


def slopes(e: np.ndarray, axis: Axis, kinds: tuple[str, ...], theta: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Derivatives by the natural parameters of log determinant plus the sum of the whitened squares of the columns ``e`` (rows, times, columns).

    NaN in the first column is a gap.  Covariances do not depend on the values; where steps are equal and no row has a
    gap they come to rest, and are then taken as they are until a step or a gap moves them again.
    """
    if len(e) > chunk:
        return np.concatenate([slopes(e[i : i + chunk], axis, kinds, theta[i : i + chunk], chunk) for i in range(0, len(e), chunk)])
    b, steps, columns = e.shape
    m = Tangents(kinds, theta)
    there = np.isfinite(e[:, :, 0]).T
    z = np.ascontiguousarray(np.where(there.T[:, :, None], e, 0.0).transpose(1, 2, 0))  # time, column, row
    d, heads, pairs, inside = m.d, m.heads, m.pairs, m.inside
    with np.errstate(all="ignore"):
        if not d:
            n, squares = there.sum(axis=0), (z * z).sum(axis=(0, 1))
            return (m.r[1:] * (n - squares / m.r[0]) / m.r[0]).T
        reps, group = axis.groups()
        moves = [m.move(dt) for dt in reps]
        p = m.begin()
        x = [np.zeros((1 + m.p, columns, b)) for _ in range(d)]
        out = np.zeros((m.p, b))
        whole, some = there.all(axis=1), there.any(axis=1)
        at = lambda i, j: p[(i, j) if i >= j else (j, i)]
        rest, before, last, kept = False, None, -1, ()

        def updated(gain: list, dgain: list, ph: list) -> None:
            for i, j in pairs:
                p[i, j] = p[i, j] - gain[i] * ph[j]
                p[i, j][1:] -= dgain[i] * ph[j][0]

        for t in range(steps):
            if t:
                if rest and not (group[t - 1] == last and whole[t]):
                    rest = False
                    updated(*kept[2:])  # of the last sample, which left the covariance as it was predicted
                last = group[t - 1]
                f, df, q = moves[last]
                moved = []
                for i in range(d):
                    new = f[i, inside[i][0]] * x[inside[i][0]]
                    for k in inside[i][1:]:
                        new += f[i, k] * x[k]
                    for k in inside[i]:
                        for a, g in df[i, k]:
                            new[a] += g * x[k][0]
                    moved.append(new)
                x = moved
                if not rest:
                    half = {}
                    for i in range(d):
                        for j in range(d):
                            new = f[i, inside[i][0]] * at(inside[i][0], j)
                            for k in inside[i][1:]:
                                new += f[i, k] * at(k, j)
                            for k in inside[i]:
                                for a, g in df[i, k]:
                                    new[a] += g * at(k, j)[0]
                            half[i, j] = new
                    p = {}
                    for i, j in pairs:
                        new = half[i, inside[j][0]] * f[j, inside[j][0]]
                        for k in inside[j][1:]:
                            new += half[i, k] * f[j, k]
                        for k in inside[j]:
                            for a, g in df[j, k]:
                                new[a] += half[i, k][0] * g
                        if (i, j) in q:
                            new += q[i, j]
                        p[i, j] = new
                    if t % 8 == 0 and before is not None and whole[t]:
                        rest = all((np.abs(p[i, j] - before[i, j]) <= REST * np.maximum(np.abs(p[i, j]), np.sqrt(p[i, i][0] * p[j, j][0]))).all() for i, j in pairs)
                    before = {ij: v.copy() for ij, v in p.items()} if t % 8 == 7 and whole[t] else None
                    kept = ()
            if not some[t]:
                continue
            if not kept:
                ph = []
                for i in range(d):
                    new = at(i, heads[0])
                    for h in heads[1:]:
                        new = new + at(i, h)
                    ph.append(new)
                s = m.r + ph[heads[0]]
                for h in heads[1:]:
                    s = s + ph[h]
                w = 1 / s[0] if whole[t] else np.where(there[t], 1 / s[0], 0.0)
                gain = [h[0] * w for h in ph]
                dgain = [(h[1:] - g * s[1:]) * w for h, g in zip(ph, gain, strict=True)]
                kept = w, s[1:], gain, dgain, [h.copy() for h in ph] if rest else ph
                if not rest:
                    updated(gain, dgain, ph)
            w, ds, gain, dgain, _ = kept
            v = -x[heads[0]]
            for h in heads[1:]:
                v = v - x[h]
            v[0] += z[t]
            wv = w * v[0]
            out += ds * (w * (1 - (wv * v[0]).sum(axis=0))) + 2 * (wv * v[1:]).sum(axis=1)
            for i in range(d):
                x[i] += gain[i] * v
                x[i][1:] += dgain[i][:, None] * v[0]
    return out.T


def richardson(f, u: np.ndarray, h: float = 1e-2, levels: int = 4) -> np.ndarray:
    """The gradient of ``f`` (rows of points to values) at one point, by central differences extrapolated to no step."""
    p = len(u)
    table = []
    for k in range(levels):
        step = np.eye(p) * h / 2**k
        values = f(np.concatenate((u + step, u - step)))
        row = [(values[:p] - values[p:]) / (2 * h / 2**k)]
        for j in range(k):
            row.append(row[j] + (row[j] - table[-1][j]) / (4 ** (j + 1) - 1))
        table.append(row)
    return table[-1][-1]


def probe() -> tuple[np.ndarray, np.ndarray]:
    """Times with two different steps and a series with gaps, by a fixed rule."""
    i = np.arange(36)
    t = 2000 + i / 12 + (i >= 20) * 0.3
    y = np.sin(i * 1.7) + 0.4 * np.cos(i * i * 0.37) + 0.02 * i
    return t, np.where((i % 7 == 3) | ((i > 10) & (i < 14)), np.nan, y)


def verified(model: str | tuple[str, ...] | Layout, objective: str, agreement: float = AGREEMENT) -> str:
    """``analytic`` if every term has derivatives and they agree with Richardson differences, ``finite_difference`` if a term has none.

    Derivatives that do not agree are refused with an AnalyticGradientError.
    """
    layout = Layout.of(model)
    if not layout.free or not differentiable(layout):
        return "finite_difference"
    return _verified(layout, objective, agreement, tuple(id(FAMILIES[k]) for k in layout.kinds))


@lru_cache(maxsize=256)
def _verified(layout: Layout, objective: str, agreement: float, families: tuple[int, ...]) -> str:
    from tidewright.operators.fitting import Axis, Objective

    t, y = probe()
    fun = Objective(y[None, :], Axis(t, np.stack([np.ones(len(t)), t - t.mean()], 1), 1), layout, objective, gradient="analytic")
    u = layout.unconstrained(np.array([[0.7 + 0.13 * k for k in range(len(layout.free))]]))[0]
    value, got = fun.with_gradient(u[None, :], np.zeros(1, int))
    want = richardson(lambda points: fun(points, np.zeros(len(points), int)), u)
    if not np.abs(got[0] - want).max() <= agreement * max(1.0, abs(float(value[0]))):
        raise AnalyticGradientError(f"the derivatives of {' + '.join(layout.kinds)} for {objective} differ from differences of the likelihood: {got[0]} and {want}")
    return "analytic"
