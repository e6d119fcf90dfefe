"""Straight-line reports: slope, intercept, their scatter, and how far a series bends from its line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_report(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, slope, intercept, residual_sd, slope_err, half_difference) of each key, from one aggregation and one join.

    ``half_difference`` is the mean residual of the half of larger x less that of the other half: 0 for a straight line.
    """
    d = df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    rest = F.regr_syy("y", "x") - F.regr_slope("y", "x") * F.regr_sxy("y", "x")
    fit = d.groupBy("k").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.sqrt(F.when(F.count("*") > 2, F.try_divide(F.greatest(rest, F.lit(0.0)), F.count("*") - 2))).alias("residual_sd"), F.regr_sxx("y", "x").alias("sxx"), F.avg("x").alias("mean_x"))
    fit = fit.withColumn("slope_err", F.try_divide(F.col("residual_sd"), F.sqrt("sxx")))
    residual = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    upper = F.avg(F.when(F.col("x") > F.col("mean_x"), residual)) - F.avg(F.when(F.col("x") <= F.col("mean_x"), residual))
    bend = d.join(fit, "k").groupBy("k").agg(upper.alias("half_difference"))
    return fit.join(bend, "k").select(F.col("k").alias(key), "n", "slope", "intercept", "residual_sd", "slope_err", "half_difference")
