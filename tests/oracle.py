"""Dense oracles in numpy, independent of the filters."""

from __future__ import annotations

import numpy as np


def covariance(t: np.ndarray, sigma: float, rho: float, tau: float, matern32: bool = False) -> np.ndarray:
    lag = np.abs(t[:, None] - t[None, :]) / rho
    k = (1 + np.sqrt(3) * lag) * np.exp(-np.sqrt(3) * lag) if matern32 else np.exp(-lag)
    return sigma**2 * k + tau**2 * np.eye(len(t))


def loglik(y: np.ndarray, cov: np.ndarray, x: np.ndarray | None = None, reml: bool = False) -> float:
    inverse = np.linalg.inv(cov)
    extra = 0.0
    if x is not None:
        g = x.T @ inverse @ x
        y = y - x @ np.linalg.solve(g, x.T @ inverse @ y)
        if reml:
            extra = x.shape[1] / 2 * np.log(2 * np.pi) + 0.5 * np.linalg.slogdet(x.T @ x)[1] - 0.5 * np.linalg.slogdet(g)[1]
    return float(-0.5 * (len(y) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + y @ inverse @ y) + extra)
