from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidewright.functions.criteria import value
from tidewright.functions.outcomes import merge
from tidewright.operators import counting, grid, selection

SCORES = "series_id bigint, m int, loglik double, k double, n double, n_eff double, outcome int, engine string, objective string"


def scores(spark, rows):
    return spark.createDataFrame([(*r, "kalman", "ml") for r in rows], SCORES)


@pytest.mark.parametrize(("criterion", "n", "want"), [("aic", 50, 208), ("bic", 50, 4 * math.log(50) + 200), ("aicc", 50, 208 + 40 / 45), ("hqic", 50, 8 * math.log(math.log(50)) + 200), ("hqic", math.e, None), ("bic", 1, None), ("aicc", 5, math.inf), ("bic_neff", 50, 4 * math.log(20) + 200)])
def test_criteria(spark, criterion, n, want):
    df = spark.createDataFrame([(-100.0, 4.0, float(n), 20.0)], "l double, k double, n double, e double")
    got = df.select(value(criterion, *(F.col(c) for c in "lkne"))).first()[0]
    assert got == want if want is None else got == pytest.approx(want)


def test_rank_ties_failures_and_infinite_values(spark):
    rows = [(1, 0, -10.0, 2.0, 50.0, 50.0, 0), (1, 1, -10.0, 2.0, 50.0, 50.0, 0), (1, 2, None, None, None, None, 6), (2, 0, None, None, None, None, 10), (3, 0, -1.0, 4.0, 5.0, 5.0, 0)]
    got = {(r.series_id, r.m, r.criterion): r for r in selection.rank(scores(spark, rows), ("aic", "aicc")).collect()}
    assert got[1, 1, "aic"].selected == 0 and got[1, 1, "aic"].weight == pytest.approx(0.5)
    assert got[1, 2, "aic"].delta_ic is None and got[1, 2, "aic"].weight == 0 and got[1, 0, "aic"].n_valid == 2
    assert got[2, 0, "aic"].selected == -1 and got[2, 0, "aic"].ic_best is None
    assert got[3, 0, "aicc"].selected == -1 and got[3, 0, "aicc"].n_valid == 1 and got[3, 0, "aicc"].weight == 0


def test_guards(spark):
    fine = scores(spark, [(1, 0, -1.0, 1.0, 9.0, 9.0, 0), (1, 1, None, None, None, None, 5)])
    selection.check_invariant(selection.check_comparable(fine))
    with pytest.raises(selection.InvariantError):
        selection.check_invariant(scores(spark, [(1, 0, None, 1.0, 9.0, 9.0, 0)]))
    with pytest.raises(selection.InvariantError):
        selection.check_invariant(scores(spark, [(1, 0, -1.0, 1.0, 9.0, 9.0, 6)]))
    with pytest.raises(selection.ComparabilityError):
        selection.check_comparable(fine.withColumn("engine", F.concat(F.lit("e"), F.col("m"))))


def test_merge_and_points(spark):
    df = spark.createDataFrame([(0, 6, 10), (3, 4, 0)], "a int, b int, c int")
    assert [r[0] for r in df.select(merge(F.col("a"), F.col("b"), F.col("c"))).collect()] == [10, 3]


def test_effective_sizes_of_one_series_agree(spark):
    samples = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(12)], "series_id bigint, i int, t double, v double")
    regular = counting.n_eff_regular(counting.lag_pairs(samples), F.exp(F.col("lag") * -0.5)).first()
    from tidewright.operators.series import pack

    dense = counting.n_eff_irregular(pack(samples), "exp(-0.5D * d)").first()
    closed = samples.groupBy("series_id").agg(F.count("*").alias("n")).select(counting.n_eff_closed_form(F.col("n"), lambda k: F.exp(k * -0.5))).first()[0]
    assert regular.n_eff == pytest.approx(dense.n_eff) == pytest.approx(closed)


def test_tiles_cover_the_grid_once(spark):
    points = spark.createDataFrame([(y * 7 + x, y, x) for y in range(5) for x in range(7)], "series_id bigint, y bigint, x bigint")
    s = grid.spans(points, 2, 3).where("axis = 'x'").collect()
    covered = sorted(i for r in s for i in range(r.start, r.end))
    assert covered == list(range(7))
    assert all(r.amplification >= 1 for r in grid.read_amplification(grid.spans(points, 2, 3)).collect())
