"""Outcome codes of a fit, and columns over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stored code of each outcome.
CODES = {
    "OK": 0, "ITER_CAP_SMALL_GRAD": 1, "ITER_CAP_LARGE_GRAD": 2, "DIAGNOSTIC_LIMIT": 3, "TRUST_RADIUS_COLLAPSED": 4, "NONFINITE_OBJECTIVE": 5, "RANK_DEFICIENT_X": 6,
    "DEGENERATE_HESSIAN": 7, "NOT_ATTEMPTED": 8, "CANDIDATE_DROPPED": 9, "INSUFFICIENT_DATA": 10, "ILL_CONDITIONED_X": 11, "SCREENED_OUT": 12, "NOT_APPLICABLE": 13,
}
# What counts first when several outcomes meet; outcomes that are not named come before OK.
PRECEDENCE = ("INSUFFICIENT_DATA", "NOT_ATTEMPTED", "RANK_DEFICIENT_X", "ILL_CONDITIONED_X", "NONFINITE_OBJECTIVE")
# Outcomes that are not in a failure rate's denominator, and outcomes that are no failures.
INELIGIBLE = ("INSUFFICIENT_DATA", "NOT_APPLICABLE")
NO_FAILURE = ("OK", "NOT_ATTEMPTED", "INSUFFICIENT_DATA", "SCREENED_OUT", "NOT_APPLICABLE")


def is_ok(code: Column) -> Column:
    return code == CODES["OK"]


def is_eligible(code: Column) -> Column:
    return ~code.isin(*(CODES[x] for x in INELIGIBLE))


def is_failure(code: Column) -> Column:
    return ~code.isin(*(CODES[x] for x in NO_FAILURE))


def precedence(code: Column) -> Column:
    """Rank of a code, least first: the named ones in order, then the others, then OK."""
    named = reduce(lambda c, x: c.when(code == CODES[x[1]], x[0]), enumerate(PRECEDENCE), F.when(is_ok(code), len(PRECEDENCE) + 1))
    return named.otherwise(len(PRECEDENCE))


def merge(*codes: Column) -> Column:
    """The code that counts first; of equal rank the first argument."""
    return F.array_min(F.array(*(F.struct(precedence(c).alias("rank"), F.lit(i).alias("place"), c.alias("code")) for i, c in enumerate(codes))))["code"]


def point_outcome(code: Column) -> Column:
    """Aggregate over the candidates of a series: OK if any is, else the code that counts first."""
    return F.when(F.max(is_ok(code)), F.lit(0)).otherwise(F.min(F.struct(precedence(code), code.alias("code")))["code"])
