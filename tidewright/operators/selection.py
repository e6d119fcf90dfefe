"""Ranking of candidate models per series, and the tables around it.

Scores: (series_id, m, loglik, k, n, n_eff, outcome, engine, objective), one row per series and candidate.  A candidate
that did not come out OK has no values; one whose criterion is NULL or infinite has no weight and never wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.criteria import value
from tidewright.functions.outcomes import is_eligible, is_failure, is_ok, point_outcome


class ComparabilityError(ValueError):
    """Scores of different engines or objectives cannot be ranked together."""


class InvariantError(ValueError):
    """Values where an outcome forbids them, or none where it asks for them."""


def ic_values(scores: DataFrame, criteria: tuple[str, ...]) -> DataFrame:
    """(series_id, m, outcome, criterion, ic): every criterion of every score, NULL unless OK."""
    c = F.array(*(F.struct(F.lit(x).alias("criterion"), F.when(is_ok(F.col("outcome")), value(x, F.col("loglik"), F.col("k"), F.col("n"), F.col("n_eff"))).alias("ic")) for x in criteria))
    return scores.select("series_id", "m", "outcome", F.inline(c))


def rank(scores: DataFrame, criteria: tuple[str, ...]) -> DataFrame:
    """Adds delta_ic, weight, ic_best, selected (-1: none) and n_valid to every series, candidate and criterion.

    One window over the candidates of a series and criterion serves all of them.
    """
    group = Window.partitionBy("series_id", "criterion")
    ic = ic_values(scores, criteria)
    can_win = F.col("ic").isNotNull() & (F.abs("ic") != float("inf")) & ~F.isnan("ic")
    out = ic.withColumn("usable", F.when(can_win, F.col("ic"))).withColumn("ic_best", F.min("usable").over(group))
    out = out.withColumn("selected", F.coalesce(F.min(F.when(can_win, F.struct("ic", "m"))).over(group)["m"], F.lit(-1)))
    out = out.withColumn("n_valid", F.count_if(is_ok(F.col("outcome"))).over(group)).withColumn("delta_ic", F.col("ic") - F.col("ic_best"))
    out = out.withColumn("raw", F.when(F.col("usable").isNotNull(), F.exp(-(F.col("usable") - F.col("ic_best")) / 2)).otherwise(0.0))
    return out.withColumn("weight", F.coalesce(F.try_divide(F.col("raw"), F.sum("raw").over(group)), F.lit(0.0))).drop("usable", "raw")


def best(ranked: DataFrame) -> DataFrame:
    """(series_id, criterion, ic_best, selected, n_valid)."""
    return ranked.groupBy("series_id", "criterion").agg(F.first("ic_best").alias("ic_best"), F.first("selected").alias("selected"), F.first("n_valid").alias("n_valid"))


def points(scores: DataFrame) -> DataFrame:
    """(series_id, n_valid, point_outcome)."""
    return scores.groupBy("series_id").agg(F.count_if(is_ok(F.col("outcome"))).alias("n_valid"), point_outcome(F.col("outcome")).alias("point_outcome"))


def failure_rates(scores: DataFrame) -> DataFrame:
    """(m, n_eligible, n_failed, failure_rate) of each candidate."""
    o = F.col("outcome")
    rates = scores.groupBy("m").agg(F.count_if(is_eligible(o)).alias("n_eligible"), F.count_if(is_failure(o)).alias("n_failed"))
    return rates.withColumn("failure_rate", F.try_divide(F.col("n_failed").cast("double"), F.col("n_eligible")))


def mixed(scores: DataFrame) -> DataFrame:
    """(series_id, n_engines, n_objectives) of series whose scores cannot be compared."""
    return scores.groupBy("series_id").agg(F.countDistinct("engine").alias("n_engines"), F.countDistinct("objective").alias("n_objectives")).where("n_engines > 1 or n_objectives > 1")


def check_comparable(scores: DataFrame) -> DataFrame:
    """The scores, refused if any series mixes engines or objectives."""
    if not (found := mixed(scores).limit(1)).isEmpty():
        raise ComparabilityError(f"series {found.first().series_id} mixes engines or objectives")
    return scores


def violations(scores: DataFrame, values: tuple[str, ...] = ("loglik", "k", "n"), exempt: tuple[str, ...] = ()) -> DataFrame:
    """One row: how many rows break the status invariant (not OK with a value, OK without one, a negative infinity)."""
    asked = [F.col(v) for v in values if v not in exempt]
    some = lambda c: c.isNotNull() & ~F.isnan(c)
    ok = is_ok(F.col("outcome"))
    false = F.lit(False)
    has, lacks, sunk = false, false, false
    for c in (F.col(v).cast("double") for v in values):
        has, sunk = has | some(c), sunk | F.coalesce(c == float("-inf"), false)
    for c in (c.cast("double") for c in asked):
        lacks = lacks | ~some(c)
    return scores.agg(F.count("*").alias("n_rows"), F.count_if(~ok & has).alias("n_value_not_ok"), F.count_if(ok & lacks).alias("n_ok_without_value"), F.count_if(sunk).alias("n_negative_infinity"))


def check_invariant(scores: DataFrame, **kw: tuple[str, ...]) -> DataFrame:
    row = violations(scores, **kw).first()
    if row.n_value_not_ok or row.n_ok_without_value or row.n_negative_infinity:
        raise InvariantError(f"the status invariant is broken: {row.asDict()}")
    return scores


def recompute(primitives: DataFrame, criteria: tuple[str, ...]) -> DataFrame:
    """New criteria over stored primitives, without a fit."""
    return rank(check_comparable(primitives), criteria)
