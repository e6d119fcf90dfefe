"""Generalised least squares from whitened products, for one and two design columns, as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.filtering import LOG_2PI

# Logarithms of the condition of the whitened design beyond which it is called ill-conditioned and rank-deficient.
ILL_LOG_CONDITION, RANK_LOG_CONDITION = 9.010913347279289, 11.512925464970229


def solve_two(df: DataFrame) -> DataFrame:
    """Adds b0, b1, their covariance (c00, c01, c11), loglik (ML), logdet_gram, log_condition and outcome.

    ``df`` has n, logdet and the products y0=y'S⁻¹y, y1, y2 (y'S⁻¹X) and g11, g12, g22 (X'S⁻¹X).
    """
    det = F.col("g11") * F.col("g22") - F.col("g12") * F.col("g12")
    half, gap = (F.col("g11") + F.col("g22")) / 2, F.sqrt(F.pow((F.col("g11") - F.col("g22")) / 2, 2) + F.col("g12") * F.col("g12"))
    df = df.withColumn("det", det)
    # The smaller eigenvalue is the determinant over the larger: no cancellation.
    cond = F.when(F.col("det") > 0, F.log(F.try_divide((half + gap) * (half + gap), F.col("det"))) / 2)
    ok = F.col("det") > 0
    out = df.withColumn("log_condition", cond)
    for name, top in (("b0", F.col("g22") * F.col("y1") - F.col("g12") * F.col("y2")), ("b1", F.col("g11") * F.col("y2") - F.col("g12") * F.col("y1")), ("c00", F.col("g22")), ("c01", -F.col("g12")), ("c11", F.col("g11"))):
        out = out.withColumn(name, F.when(ok, F.try_divide(top, F.col("det"))))
    reduction = F.col("b0") * F.col("y1") + F.col("b1") * F.col("y2")
    out = out.withColumn("loglik", -(F.col("n") * LOG_2PI + F.col("logdet") + F.col("y0") - reduction) / 2).withColumn("logdet_gram", F.when(ok, F.log("det")))
    outcome = F.when(F.col("n") == 0, 10).when(~ok | (F.col("log_condition") > RANK_LOG_CONDITION), 6).when(F.col("log_condition") > ILL_LOG_CONDITION, 11).otherwise(0)
    return out.withColumn("outcome", outcome).drop("det")


def restricted(df: DataFrame) -> DataFrame:
    """Adds reml: the likelihood of the contrasts that a two-column design leaves, from ``loglik`` and the plain Gram (h11, h12, h22)."""
    plain = F.log(F.col("h11") * F.col("h22") - F.col("h12") * F.col("h12"))
    return df.withColumn("reml", F.col("loglik") + LOG_2PI + plain / 2 - F.col("logdet_gram") / 2)
