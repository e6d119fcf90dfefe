"""Maps between natural parameters and the unconstrained ones that are fitted.

``forward`` and ``inverse`` take numbers, arrays or Spark columns; ``slope`` and ``log_slope`` are the derivative of
``forward`` and the logarithm of its size.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _exp(x):
    return F.exp(x) if isinstance(x, Column) else np.exp(x)


def _log(x):
    return F.log(x) if isinstance(x, Column) else np.log(x)


class Bijector(Protocol):
    def forward(self, u): ...
    def inverse(self, x): ...
    def slope(self, u): ...
    def log_slope(self, u): ...


@dataclass(frozen=True)
class Identity:
    def forward(self, u):
        return u

    def inverse(self, x):
        return x

    def slope(self, u):
        return u * 0.0 + 1.0

    def log_slope(self, u):
        return u * 0.0


@dataclass(frozen=True)
class Log:
    def forward(self, u):
        return _exp(u)

    def inverse(self, x):
        return _log(x)

    def slope(self, u):
        return _exp(u)

    def log_slope(self, u):
        return u


@dataclass(frozen=True)
class Logit:
    lo: float
    hi: float

    def __post_init__(self) -> None:
        if not self.hi > self.lo:
            raise ValueError(f"the upper limit {self.hi} is not above the lower one {self.lo}")

    def share(self, u):
        if isinstance(u, Column):
            return F.when(u >= 0, 1 / (1 + F.exp(-u))).otherwise(F.exp(u) / (1 + F.exp(u)))
        return 0.5 * (1 + np.tanh(0.5 * np.asarray(u, float)))

    def forward(self, u):
        return self.lo + (self.hi - self.lo) * self.share(u)

    def inverse(self, x):
        return _log(x - self.lo) - _log(self.hi - x)

    def slope(self, u):
        return (self.hi - self.lo) * self.share(u) * self.share(-u)

    def log_slope(self, u):
        return _log(self.hi - self.lo if not isinstance(u, Column) else F.lit(self.hi - self.lo)) + _log(self.share(u)) + _log(self.share(-u))


def delta_method(cov: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """Covariance of natural parameters from that of unconstrained ones (..., p, p) and the slopes (..., p)."""
    return slopes[..., :, None] * cov * slopes[..., None, :]
