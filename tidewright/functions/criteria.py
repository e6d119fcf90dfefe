"""Information criteria as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CRITERIA = ("aic", "aicc", "bic", "bic_neff", "hqic")


def value(criterion: str, loglik: Column, k: Column, n: Column, n_eff: Column) -> Column:
    """A criterion's value: NULL outside its domain, infinity where AICc has no degrees of freedom left."""
    fit = loglik * -2.0
    if criterion == "aic":
        return fit + k * 2.0
    if criterion == "aicc":
        left = n - k - 1.0
        return F.when(left > 0, fit + k * 2.0 + F.try_divide(k * 2.0 * (k + 1.0), left)).when(left.isNotNull(), F.lit(math.inf))
    if criterion == "bic":
        return F.when(n > 1, fit + k * F.log(n))
    if criterion == "bic_neff":
        return F.when(n_eff > 1, fit + k * F.log(n_eff))
    if criterion == "hqic":
        return F.when(n > math.e, fit + k * 2.0 * F.log(F.log(n)))
    raise ValueError(f"unknown criterion {criterion!r}; known: {', '.join(CRITERIA)}")


def penalty(objective: str, n_theta: Column, design_rank: Column, n_obs: Column) -> tuple[Column, Column]:
    """(k, n): restricted likelihood has used up the design's degrees of freedom already."""
    if objective == "ml":
        return (n_theta + design_rank).cast("double"), n_obs.cast("double")
    if objective == "reml":
        return n_theta.cast("double"), (n_obs - design_rank).cast("double")
    raise ValueError(f"unknown objective {objective!r}")
