"""Noise families: parameters, autocovariance columns, and the matrices of their state-space forms in numpy."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.statespace import step_of
from tidewright.functions.transforms import Bijector, Log

# Default, and the limits beyond which a fitted parameter is not believed.
DEFAULTS = {"sigma": 1.0, "rho": 1.0}
LIMITS = {"sigma": (1e-8, 1e8), "rho": (1e-6, 1e6)}


@dataclass(frozen=True)
class Family:
    """One additive noise term; parameters are on the log scale when fitted."""

    kind: str
    params: tuple[str, ...]
    dim: int
    acvf: Callable[..., Column]
    #: numpy: (sigma, rho, dt) -> transition (…, d, d), process noise (…, d, d); (sigma, rho) -> stationary covariance
    step: Callable | None = field(default=None, compare=False)
    stationary: Callable | None = field(default=None, compare=False)
    #: numpy: (lag, parameters ...) -> autocovariance
    covariance: Callable | None = field(default=None, compare=False)
    #: numpy: derivatives by each parameter of transition, process noise and stationary covariance, where they are known
    dstep: Callable | None = field(default=None, compare=False)
    dstationary: Callable | None = field(default=None, compare=False)
    #: how each parameter is mapped for a fit (default: logarithm), and for which objectives the family claims derivatives
    bijectors: dict[str, Bijector] = field(default_factory=dict, compare=False)
    analytic: tuple[str, ...] = ()


def _ou_step(sigma: np.ndarray, rho: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(-dt / rho)[..., None, None], (-(sigma**2) * np.expm1(-2 * dt / rho))[..., None, None]


def _ou_dstep(sigma: np.ndarray, rho: np.ndarray, dt: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """d/dsigma and d/drho of (transition, process noise)."""
    f, decay = np.exp(-dt / rho), np.exp(-2 * dt / rho)
    wide = lambda x: np.asarray(x)[..., None, None]
    return [wide(0 * sigma), wide(f * dt / rho**2)], [wide(-2 * sigma * np.expm1(-2 * dt / rho)), wide(-(sigma**2) * decay * 2 * dt / rho**2)]


def _ou_dstationary(sigma: np.ndarray, rho: np.ndarray) -> list[np.ndarray]:
    return [np.asarray(2 * sigma)[..., None, None], np.asarray(0 * rho)[..., None, None]]


#: Below this u the closed forms cancel; the Maclaurin coefficients of both noise terms follow from exp's.
SERIES_BELOW, CLAMP, ORDER = 1.0, 60.0, 22
_FACTORIAL = np.array([math.factorial(n) for n in range(ORDER + 1)], float)
_N = np.arange(ORDER + 1)
_G1 = np.where(_N >= 3, (-1.0) ** (_N + 1) * (_N - 1) * (_N - 2) / (2 * _FACTORIAL), 0)
_G2 = np.where(_N >= 1, (-1.0) ** (_N + 1) * (_N * _N + _N + 2) / (2 * _FACTORIAL), 0)


def _noise_terms(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    small, big = np.minimum(u, SERIES_BELOW), np.minimum(u, CLAMP)
    e = np.exp(-big)
    return (
        np.where(u < SERIES_BELOW, np.polynomial.polynomial.polyval(small, _G1), 1 - e * (1 + big + big * big / 2)),
        np.where(u < SERIES_BELOW, np.polynomial.polynomial.polyval(small, _G2), 1 - e * (1 - big + big * big / 2)),
    )


def _m32_step(sigma: np.ndarray, rho: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    lam = math.sqrt(3) / rho
    u, decay = 2 * lam * dt, np.exp(-lam * dt)
    f = decay[..., None, None] * np.stack([np.stack([1 + lam * dt, np.full_like(lam, dt)], -1), np.stack([-(lam**2) * dt, 1 - lam * dt], -1)], -2)
    g1, g2 = _noise_terms(u)
    cross = 2 * lam**3 * dt**2 * np.exp(-np.minimum(u, 700.0))
    q = (sigma**2)[..., None, None] * np.stack([np.stack([g1, cross], -1), np.stack([cross, lam**2 * g2], -1)], -2)
    return f, q


def _m32_stationary(sigma: np.ndarray, rho: np.ndarray) -> np.ndarray:
    out = np.zeros((*np.shape(sigma), 2, 2))
    out[..., 0, 0], out[..., 1, 1] = sigma**2, sigma**2 * 3 / rho**2
    return out


def _m32_dstep(sigma: np.ndarray, rho: np.ndarray, dt: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """d/dsigma and d/drho of (transition, process noise), through d/dlambda with lambda = sqrt(3) / rho."""
    lam = math.sqrt(3) / rho
    u, turn = 2 * lam * dt, -lam / rho
    square = lambda a, b, c, d: np.stack([np.stack([a, b], -1), np.stack([c, d], -1)], -2)
    df = np.exp(-lam * dt)[..., None, None] * square(-lam * dt**2, np.full_like(lam, -(dt**2)), -2 * lam * dt + lam**2 * dt**2, -2 * dt + lam * dt**2)
    e = np.exp(-np.minimum(u, 700.0))
    g1, g2 = _noise_terms(u)
    d1, d2 = e * u * u / 2, e * (2 - 2 * u + u * u / 2)
    cross = 2 * lam**3 * dt**2 * e
    dcross = 2 * lam**2 * dt**2 * e * (3 - u)
    q, dq = square(g1, cross, cross, lam**2 * g2), square(2 * dt * d1, dcross, dcross, 2 * lam * g2 + 2 * dt * lam**2 * d2)
    return [np.zeros_like(df), df * turn[..., None, None]], [2 * sigma[..., None, None] * q, (sigma**2 * turn)[..., None, None] * dq]


def _m32_dstationary(sigma: np.ndarray, rho: np.ndarray) -> list[np.ndarray]:
    by_sigma, by_rho = np.zeros((*np.shape(sigma), 2, 2)), np.zeros((*np.shape(sigma), 2, 2))
    by_sigma[..., 0, 0], by_sigma[..., 1, 1] = 2 * sigma, 6 * sigma / rho**2
    by_rho[..., 1, 1] = -6 * sigma**2 / rho**3
    return [by_sigma, by_rho]


def _white_acvf(lag: Column, sigma: Column | float) -> Column:
    s = F.lit(sigma) if not isinstance(sigma, Column) else sigma
    return F.when(lag == 0, s * s).otherwise(0.0)


def _ou_acvf(lag: Column, sigma: Column | float, rho: Column | float) -> Column:
    s, r = (x if isinstance(x, Column) else F.lit(x) for x in (sigma, rho))
    return s * s * F.exp(-F.abs(lag) / r)


def _m32_acvf(lag: Column, sigma: Column | float, rho: Column | float) -> Column:
    s, r = (x if isinstance(x, Column) else F.lit(x) for x in (sigma, rho))
    a = F.abs(lag) * math.sqrt(3) / r
    return s * s * (a + 1.0) * F.exp(-a)


FAMILIES = {
    "white": Family("white", ("sigma",), 0, _white_acvf, covariance=lambda lag, s: np.where(lag == 0, s * s, 0.0)),
    "matern12": Family("matern12", ("sigma", "rho"), 1, _ou_acvf, _ou_step, lambda s, r: (s**2)[..., None, None], lambda lag, s, r: s * s * np.exp(-np.abs(lag) / r), _ou_dstep, _ou_dstationary, analytic=("ml",)),
    "matern32": Family("matern32", ("sigma", "rho"), 2, _m32_acvf, _m32_step, _m32_stationary, lambda lag, s, r: s * s * (1 + np.abs(lag) * math.sqrt(3) / r) * np.exp(-np.abs(lag) * math.sqrt(3) / r), _m32_dstep, _m32_dstationary),
}


class CandidateError(ValueError):
    """A candidate expression that names no sum of known families."""


def register(family: Family) -> None:
    if family.kind in FAMILIES:
        raise CandidateError(f"the family {family.kind!r} is registered already")
    FAMILIES[family.kind] = family


def from_drift(kind: str, params: tuple[str, ...], dim: int, drift: Callable[..., np.ndarray], stationary: Callable[..., np.ndarray], acvf: Callable[..., Column], covariance: Callable | None = None) -> Family:
    """A family without closed forms: ``drift`` and ``stationary`` give (…, d, d) from arrays of its parameters."""
    return Family(kind, params, dim, acvf, step_of(drift, stationary), stationary, covariance)


class AnalyticGradientError(ValueError):
    """A family that claims derivatives it does not have."""


def _term(text: str) -> tuple[str, dict[str, float]]:
    """The kind of a term and the values that it fixes, as in ``matern12(rho=1.5)``."""
    kind, bracket, rest = (x.strip() for x in text.strip().partition("("))
    if kind not in FAMILIES:
        raise CandidateError(f"{kind!r} in {text!r} is no family; known: {', '.join(sorted(FAMILIES))}")
    fixed: dict[str, float] = {}
    if bracket:
        if not rest.endswith(")"):
            raise CandidateError(f"{text!r} has no closing bracket")
        for part in rest[:-1].split(","):
            name, _, value = (x.strip() for x in part.partition("="))
            if name not in FAMILIES[kind].params:
                raise CandidateError(f"{kind} has no parameter {name!r}; it has {', '.join(FAMILIES[kind].params)}")
            if name in fixed:
                raise CandidateError(f"{text!r} fixes {name} twice")
            try:
                fixed[name] = float(value)
            except ValueError:
                raise CandidateError(f"{name} is fixed to a number, got {value!r}") from None
            if not math.isfinite(fixed[name]):
                raise CandidateError(f"{name} is fixed to a finite number, got {value!r}")
    return kind, fixed


def terms(text: str) -> list[tuple[str, dict[str, float]]]:
    """(kind, fixed values) of each term of a sum, in canonical order: by kind, then by what is fixed."""
    found, depth, start = [], 0, 0
    for i, c in enumerate(text + "+"):
        depth += (c == "(") - (c == ")")
        if c == "+" and depth == 0:
            found.append(_term(text[start:i]))
            start = i + 1
    if depth:
        raise CandidateError(f"the brackets of {text!r} do not match")
    return sorted(found, key=lambda x: (x[0], sorted(x[1].items())))


def candidate(text: str) -> tuple[str, ...]:
    """The kinds of a sum such as ``"white + matern12"``, in canonical order."""
    return tuple(kind for kind, _ in terms(text))


@dataclass(frozen=True)
class Layout:
    """The parameters of a candidate: all of them in order, which are free, and the values of the others."""

    kinds: tuple[str, ...]
    names: tuple[tuple[str, str], ...]
    fixed: tuple[float | None, ...]

    @classmethod
    def of(cls, text: str | tuple[str, ...] | Layout) -> Layout:
        if isinstance(text, Layout):
            return text
        parts = [(k, {}) for k in text] if isinstance(text, tuple) else terms(text)
        kinds = tuple(k for k, _ in parts)
        values = [fixed.get(name) for kind, fixed in parts for name in FAMILIES[kind].params]
        return cls(kinds, tuple(parameters(kinds)), tuple(values))

    @property
    def free(self) -> list[int]:
        return [i for i, v in enumerate(self.fixed) if v is None]

    @property
    def free_names(self) -> list[tuple[str, str]]:
        return [self.names[i] for i in self.free]

    def bijectors(self) -> list[Bijector]:
        """The map of each free parameter."""
        by_term = dict(zip(labels(self.kinds), self.kinds, strict=True))
        return [FAMILIES[by_term[term]].bijectors.get(name, Log()) for term, name in self.free_names]

    def natural(self, u: np.ndarray) -> np.ndarray:
        """Free unconstrained parameters (rows) as natural ones."""
        return np.stack([b.forward(u[:, i]) for i, b in enumerate(self.bijectors())], axis=1) if u.shape[1] else u

    def unconstrained(self, theta: np.ndarray) -> np.ndarray:
        return np.stack([b.inverse(theta[:, i]) for i, b in enumerate(self.bijectors())], axis=1) if theta.shape[1] else theta

    def slopes(self, u: np.ndarray) -> np.ndarray:
        return np.stack([b.slope(u[:, i]) for i, b in enumerate(self.bijectors())], axis=1) if u.shape[1] else u

    def hydrate(self, free: np.ndarray) -> np.ndarray:
        """All natural parameters, from the free ones and the fixed values."""
        out = np.tile(np.array([0.0 if v is None else v for v in self.fixed]), (len(free), 1))
        out[:, self.free] = free
        return out


def gradient_mode(text: str, objective: str, families: list[Family] | None = None) -> str:
    """``analytic`` if every term claims derivatives for the objective, else ``finite_difference``; an empty claim is refused."""
    found = families if families is not None else [FAMILIES[k] for k in candidate(text)]
    for f in found:
        if objective in f.analytic and (f.dstep is None or f.dstationary is None):
            raise AnalyticGradientError(f"{f.kind} claims derivatives for {objective} but has none of its matrices")
    return "analytic" if found and all(objective in f.analytic for f in found) else "finite_difference"


def labels(kinds: tuple[str, ...]) -> list[str]:
    """``kind[i]`` for each term, counting the earlier terms of its kind."""
    return [f"{k}[{kinds[:i].count(k)}]" for i, k in enumerate(kinds)]


def parameters(kinds: tuple[str, ...]) -> list[tuple[str, str]]:
    """(term, name) of the free parameters, in the order of their vector."""
    return [(label, name) for label, kind in zip(labels(kinds), kinds, strict=True) for name in FAMILIES[kind].params]


def acvf(kinds: tuple[str, ...], theta: list, lag: Column) -> Column:
    """The autocovariance of the sum at a lag; ``theta`` holds numbers or columns."""
    out, i = F.lit(0.0), 0
    for kind in kinds:
        f = FAMILIES[kind]
        out = out + f.acvf(lag, *theta[i : i + len(f.params)])
        i += len(f.params)
    return out
