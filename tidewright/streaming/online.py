"""The Matérn-1/2 plus white filter over a stream: its state is a sufficient statistic of each series.

Each micro-batch takes the state of the series that it brings, applies their new samples in order of time and returns the
likelihood so far.  Samples that are not later than the last one used are late: they are counted and left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LOG_2PI = float(np.log(2 * np.pi))
OUT = "series_id bigint, n bigint, loglik double, n_late bigint"
STATE = "x double, p double, t double, q double, l double, n bigint, late bigint"


def updated(state: tuple, t: np.ndarray, v: np.ndarray, sigma: float, rho: float, tau: float) -> tuple:
    """The state after samples in order of time."""
    x, p, last, q, l, n, late = state
    for at, y in zip(t.tolist(), v.tolist(), strict=True):
        if n and at <= last:
            late += 1
            continue
        if n:
            f = np.exp((last - at) / rho)
            x, p = f * x, f * f * p - sigma * sigma * np.expm1(2 * (last - at) / rho)
        last = at
        s = p + tau * tau
        d = y - x
        x, p, q, l, n = x + p / s * d, p - p / s * p, q + d * d / s, l + np.log(s), n + 1
    return float(x), float(p), float(last), float(q), float(l), int(n), int(late)


def online_loglik(stream: DataFrame, sigma: float, rho: float, tau: float) -> DataFrame:
    """(series_id, n, loglik, n_late) of each series in a batch, from a stream of (series_id, t, v); NULL values are gaps."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0.0, sigma * sigma, 0.0, 0.0, 0.0, 0, 0)
        new = pd.concat(list(parts)).dropna(subset=["t", "v"]).sort_values(["t", "v"])
        now = updated(tuple(now), new["t"].to_numpy(float), new["v"].to_numpy(float), sigma, rho, tau)
        state.update(now)
        yield pd.DataFrame({"series_id": [key[0]], "n": [now[5]], "loglik": [-0.5 * (now[5] * LOG_2PI + now[4] + now[3])], "n_late": [now[6]]})

    return stream.select("series_id", "t", "v").groupBy("series_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
