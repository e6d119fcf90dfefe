"""What evaluates a likelihood: an engine turns series, axis and parameters into whitened products.

Anything with ``engine_id`` and ``score`` is an engine; ``fit`` takes one, and its name is stored with the results.
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Protocol, runtime_checkable

import numpy as np

if TYPE_CHECKING:
    from tidewright.operators.fitting import Axis


@runtime_checkable
class Engine(Protocol):
    engine_id: str

    def score(self, y: np.ndarray, axis: Axis, kinds: tuple[str, ...], theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, log determinant, whitened products of [y, X]) of each row of ``y``; NaN is a gap."""
        ...


class KalmanEngine:
    """The state-space filter, all rows side by side."""

    engine_id = "kalman"

    def score(self, y: np.ndarray, axis: Axis, kinds: tuple[str, ...], theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        from tidewright.operators.fitting import products

        return products(y, axis, kinds, theta)


class DenseEngine:
    """The same numbers from the whole covariance of each series: cubic in its length, for short series and checks."""

    engine_id = "dense"

    def score(self, y: np.ndarray, axis: Axis, kinds: tuple[str, ...], theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        from tidewright.functions.families import FAMILIES

        b, q = len(y), 1 + axis.x.shape[-1]
        n, logdet, out = np.isfinite(y).sum(axis=1), np.zeros(b), np.full((b, q, q), np.nan)
        for i in range(b):
            on = np.isfinite(y[i])
            at = np.flatnonzero(on)
            lag, same = axis.t[at][:, None] - axis.t[at][None, :], at[:, None] == at[None, :]
            cov, k = np.zeros((len(at), len(at))), 0
            for kind in kinds:
                f = FAMILIES[kind]
                own = theta[i, k : k + len(f.params)]
                k += len(f.params)
                cov += f.covariance(lag, *own) if f.dim else np.where(same, own[0] ** 2, 0.0)
            z = np.concatenate((y[i][on][:, None], (axis.x if axis.x.ndim == 2 else axis.x[i])[on]), axis=1)
            try:
                root = np.linalg.cholesky(cov)
            except np.linalg.LinAlgError:
                logdet[i] = np.nan
                continue
            w = np.linalg.solve(root, z)
            logdet[i], out[i] = 2 * np.log(np.diag(root)).sum(), w.T @ w
        return n, logdet, out


ENGINES: dict[str, Engine] = {"kalman": KalmanEngine(), "dense": DenseEngine()}


def register(engine: Engine) -> None:
    if engine.engine_id in ENGINES:
        raise ValueError(f"the engine {engine.engine_id!r} is registered already")
    ENGINES[engine.engine_id] = engine
