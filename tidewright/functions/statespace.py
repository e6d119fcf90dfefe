"""Families that are given by their drift: transitions for many rows at once.

A family without closed forms is a drift matrix and a stationary covariance, both functions of its parameters; the
transition of a step is the exponential of the drift, and the noise is what the stationary covariance has beyond what is carried over.
Rows whose eigenvectors are well apart take the exponential from them, the others from a squared Taylor sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# Fixed value: the condition of the eigenvectors beyond which a transition by them is not trusted.
EIGEN_CONDITION_LIMIT = 4.5e7
TAYLOR = 18


class DefectiveMatrixError(ValueError):
    """A drift whose eigenvectors are too close to each other."""


def expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential by scaling and squaring of a Taylor sum; ``a`` may be a stack of matrices."""
    a = np.asarray(a, float)
    size = np.abs(a).sum(axis=-1).max() if a.size else 0.0
    halvings = max(0, int(np.ceil(np.log2(max(size, 1e-300)))) + 1)
    x = a / 2.0**halvings
    out = term = np.broadcast_to(np.eye(a.shape[-1]), a.shape).copy()
    for k in range(1, TAYLOR + 1):
        term = term @ x / k
        out = out + term
    for _ in range(halvings):
        out = out @ out
    return out


def transitions(drift: np.ndarray, dt: float, limit: float = EIGEN_CONDITION_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(exp(drift dt), whether its eigenvectors gave it) for each matrix of a stack."""
    drift = np.asarray(drift, float)
    flat = drift.reshape(-1, *drift.shape[-2:])
    values, vectors = np.linalg.eig(flat)
    with np.errstate(all="ignore"):
        apart = np.linalg.cond(vectors) <= limit
    out = np.empty_like(flat)
    if apart.any():
        v = vectors[apart]
        out[apart] = np.linalg.solve(v.swapaxes(1, 2), (v * np.exp(values[apart] * dt)[:, None, :]).swapaxes(1, 2)).swapaxes(1, 2).real
    if not apart.all():
        out[~apart] = expm(flat[~apart] * dt)
    return out.reshape(drift.shape), apart.reshape(drift.shape[:-2])


def eigen_transition(drift: np.ndarray, dt: float, limit: float = EIGEN_CONDITION_LIMIT) -> np.ndarray:
    """The transitions of a stack, all of them by eigenvectors."""
    out, apart = transitions(drift, dt, limit)
    if not apart.all():
        raise DefectiveMatrixError(f"{(~apart).sum()} of {apart.size} drifts have eigenvectors of a condition above {limit:.3g}")
    return out


def safe_transition(drift: np.ndarray, dt: float, limit: float = EIGEN_CONDITION_LIMIT) -> tuple[np.ndarray, int]:
    """The transitions of a stack, and how many of them are not by eigenvectors."""
    out, apart = transitions(drift, dt, limit)
    return out, int((~apart).sum())


def step_of(drift: Callable[..., np.ndarray], stationary: Callable[..., np.ndarray]) -> Callable[..., tuple[np.ndarray, np.ndarray]]:
    """(parameters ..., dt) -> (transition, process noise) of a family that is given by its drift, a row for each series."""

    def step(*args) -> tuple[np.ndarray, np.ndarray]:
        *own, dt = args
        p = stationary(*own)
        f, _ = transitions(np.broadcast_to(drift(*own), p.shape), dt)
        q = p - f @ p @ f.swapaxes(-1, -2)
        return f, (q + q.swapaxes(-1, -2)) / 2

    return step
