from __future__ import annotations

import datetime as dt
import resource

import numpy as np
import pytest
from oracle import covariance, loglik
from pyspark.sql import functions as F

from tidewright.functions import families, statespace
from tidewright.functions.families import FAMILIES, from_drift
from tidewright.functions.timeaxis import CalendarError, calendar_of, decimal_year, timestamp_of
from tidewright.operators import counting, fitting, grid, models
from tidewright.operators import series as ops
from tidewright.operators.fitting import Axis, fit_batch, products
from tidewright.plans.config import Config
from tidewright.plans.runner import run
from tidewright.sources import inputs
from tidewright.sources.store import Store


def test_axis_over_months_and_no_task_with_all_of_it(spark):
    rng = np.random.default_rng(0)
    days = sorted({int(d) for d in rng.integers(0, 900, 300)} | {0, 30, 31, 364, 365})
    at = [dt.datetime(1999, 1, 1) + dt.timedelta(days=d, hours=int(d) % 5) for d in days]
    long = spark.createDataFrame([(s, t) for s in range(3) for t in at if (t.day + s) % 3 or s == 0] + [(9, None)], "series_id long, ts timestamp_ntz").repartition(5)
    a = ops.axis(long)
    got = a.orderBy("i").collect()
    assert [r.ts for r in got] == at and [r.i for r in got] == list(range(len(at)))
    assert got[0].dt is None and [r.dt for r in got[1:]] == [b.t - a_.t for a_, b in zip(got, got[1:])]
    assert "SinglePartition" not in a._jdf.queryExecution().executedPlan().toString()
    assert ops.axis(long.where("ts is null")).count() == 0


def test_calendars_of_equal_years(spark):
    rows = [(2000, 1, 1), (2000, 2, 28), (2000, 2, 29), (2000, 2, 30), (2000, 3, 1), (1999, 12, 31), (1969, 7, 31), (2001, 13, 1), (2001, 0, 1), (2001, 4, 0), (None, 1, 1)]
    df = spark.createDataFrame(rows, "y int, m int, d int")
    of = lambda c: [r[0] for r in df.select(decimal_year(timestamp_of(F.col("y"), F.col("m"), F.col("d"), c), calendar_of(c))).collect()]
    none = [None] * 4
    assert of("noleap") == pytest.approx([2000, 2000 + 58 / 365, None, None, 2000 + 59 / 365, 1999 + 364 / 365, 1969 + 211 / 365, *none])
    assert of("366_day") == pytest.approx([2000, 2000 + 58 / 366, 2000 + 59 / 366, None, 2000 + 60 / 366, 1999 + 365 / 366, 1969 + 212 / 366, *none])
    assert of("360_day") == pytest.approx([2000, 2000 + 57 / 360, 2000 + 58 / 360, 2000 + 59 / 360, 2000 + 60 / 360, None, None, *none])
    assert of("standard") == pytest.approx([2000, 2000 + 58 / 366, 2000 + 59 / 366, None, 2000 + 60 / 366, 1999 + 364 / 365, 1969 + 211 / 365, *none])
    with pytest.raises(CalendarError, match="unknown calendar 'julian'"):
        calendar_of("julian")


def test_run_over_a_calendar_that_timestamps_have_not(spark, tmp_path):
    """Months of 30 days are equal steps, the geometry keeps the calendar, and a date that is none is refused."""
    uri, odd, bad = (str(tmp_path / f"{n}.parquet") for n in ("in", "odd", "bad"))
    rng = np.random.default_rng(1)
    rows = [(1, 2000 + k // 12, k % 12 + 1, 30, float(rng.normal())) for k in range(48)]
    df = spark.createDataFrame(rows, "series_id long, year int, month int, day int, sla double")
    df.withMetadata("year", {"calendar": "360_day"}).write.parquet(uri)
    df.write.parquet(odd)
    df.withMetadata("year", {"calendar": "lunar"}).write.parquet(bad)
    config = lambda u: Config(data_uri=u, variable="sla", signal_terms=["constant"], candidates=["white"], criteria=["aic"])
    at = str(tmp_path / "s")
    assert run(spark, config(uri), at).n_fitted == 1
    assert Store(spark, at).provenance()["geometry"]["calendar"] == "360_day"
    got = inputs.report(spark, uri, "sla")
    assert got.calendar == "360_day" and len(got.unique_dt) == 1 and got.median_dt == pytest.approx(1 / 12)
    with pytest.raises(inputs.InputError, match="without a time"):  # 30 February
        run(spark, config(odd), str(tmp_path / "o"))
    with pytest.raises(inputs.InputError, match="lunar"):
        inputs.open_long(spark, bad, "sla")


def test_pairs_by_lag_of_a_long_series(spark):
    """100,000 places in one series, against the transform's own sums, in linear memory."""
    rng = np.random.default_rng(2)
    at = np.flatnonzero(rng.random(100_000) < 0.7) + 5
    df = spark.range(len(at)).select(F.lit(3).cast("long").alias("series_id"), F.get(F.lit(at.tolist()), F.col("id").cast("int")).cast("int").alias("i")) if len(at) < 10 else spark.createDataFrame([(3, int(i)) for i in at], "series_id long, i int")
    got = {r.lag: r.pairs for r in counting.lag_pairs(df.union(df.limit(3))).collect()}
    on = np.zeros(at[-1] - at[0] + 1, bool)
    on[at - at[0]] = True
    assert got[0] == len(at) and sum(got.values()) == len(at) * (len(at) + 1) // 2
    for lag in (1, 2, 17, 999, 50_000, len(on) - 1):
        assert got.get(lag, 0) == int((on[lag:] & on[: len(on) - lag]).sum())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    counting.pair_counts(on)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB


def test_designs_of_each_series(spark):
    """Likelihood, ranks and fits with a column that differs from series to series, against dense matrices."""
    n, b = 50, 5
    t = 2000 + np.arange(n) / 12
    rng = np.random.default_rng(3)
    w = rng.normal(size=(b, n))
    y = (np.linalg.cholesky(covariance(t, 0.6, 0.5, 0.3)) @ rng.normal(size=(n, b))).T + 0.7 * w
    y[0, 5:9] = np.nan
    w[4] = 1.0  # the same as the constant: rank deficient
    own = Axis(t, np.concatenate((np.ones((b, n, 1)), w[:, :, None]), axis=2), -1)
    for objective in ("ml", "reml"):
        got = fit_batch(y, own, "white + matern12", objective, 200)
        assert got["outcome"][4] == 5 or got["outcome"][4] != 0
        ok = np.flatnonzero(got["outcome"] == 0)
        assert len(ok) >= 2
        for i in ok:
            on = np.isfinite(y[i])
            x = np.stack([np.ones(n), w[i]], 1)[on]
            assert got["loglik"][i] == pytest.approx(loglik(y[i][on], covariance(t[on], *got["theta"][i]), x, objective == "reml"), abs=1e-8)
        alone = fit_batch(y[1:2], Axis(t, own.x[1], -1), "white + matern12", objective, 200)
        assert alone["loglik"][0] == pytest.approx(got["loglik"][1], abs=1e-6, nan_ok=True)
    big = products(np.repeat(y[:1], 2100, axis=0), Axis(t, np.repeat(own.x[:1], 2100, axis=0), -1), ("white",), np.full((2100, 1), 0.5))
    assert np.ptp(big[2], axis=0).max() == 0
    with pytest.raises(fitting.DesignError, match="2 designs do not fit 5 series"):
        fit_batch(y, Axis(t, own.x[:2], -1), "white", "ml", 5)
    rows = [(i, [(j, float(t[j]), float(y[i, j]), None if (i, j) == (1, 7) else float(w[i, j])) for j in range(n) if np.isfinite(y[i, j])]) for i in range(4)]
    packed = spark.createDataFrame(rows, "series_id long, samples array<struct<i:int,t:double,v:double,w:double>>")
    fits = {r.series_id: r for r in fitting.fit(packed, Axis(t, np.ones((n, 1)), -1), ["white"], fields=("w",)).collect()}
    for i in range(4):
        on = np.isfinite(y[i]) & ~((i == 1) & (np.arange(n) == 7))
        x = np.stack([np.ones(n), w[i]], 1)[on]
        assert fits[i].n == on.sum() and fits[i].beta == pytest.approx(np.linalg.lstsq(x, y[i][on], rcond=None)[0])


def test_covers(spark):
    points = spark.createDataFrame([(y, x) for y in range(3, 10) for x in range(-2, 6)], "y int, x int")
    tiles = grid.rectangles(points, 4)
    assert grid.check_cover(tiles, points).count() == 9  # 3 by 3 tiles, as the first row and column begin within one
    hole = tiles.where("not (ty = 1 and tx = 0)")
    with pytest.raises(grid.CoverError, match=r"\(4, 0\) is missing 1 times"):
        grid.check_cover(hole, points)
    with pytest.raises(grid.CoverError, match=r"\(9, 5\) is missing 0 times and extra 1"):
        grid.check_cover(tiles, points.where("not (y = 9 and x = 5)"))
    assert grid.uncovered(tiles.union(tiles.where("ty = 0 and tx = 0")), points).agg(F.sum("n_extra")).first()[0] == 4
    assert grid.rectangles(points.where("false"), 4).count() == 0


def test_families_that_are_given_by_their_drift(spark):
    """A drift with equal eigenvalues takes the Taylor sum; the numbers are those of the closed form."""
    lam = lambda r: np.sqrt(3) / r

    def drift(s, r):
        out = np.zeros((*np.shape(r), 2, 2))
        out[..., 0, 1], out[..., 1, 0], out[..., 1, 1] = 1, -(lam(r) ** 2), -2 * lam(r)
        return out

    closed = FAMILIES["matern32"]
    made = from_drift("drifting", ("sigma", "rho"), 2, drift, closed.stationary, closed.acvf, closed.covariance)
    s, r = np.array([0.5, 1.2, 0.8]), np.array([0.3, 2.0, 9.0])
    for step in (0.01, 0.5, 4.0):
        for a, b in zip(made.step(s, r, step), closed.step(s, r, step), strict=True):
            np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-12)
    stack = np.array([[[0.0, 1.0], [-2.0, -3.0]], [[-1.0, 1.0], [0.0, -1.0]], [[-1.0, 0.3], [0.3, -2.0]]])
    got, apart = statespace.transitions(stack, 0.7)
    assert apart.tolist() == [True, False, True]
    np.testing.assert_allclose(got, np.stack([statespace.expm(m * 0.7) for m in stack]), atol=1e-12)
    families.register(made)
    try:
        t = 2000 + np.arange(80) / 12
        y = (np.linalg.cholesky(covariance(t, 0.8, 0.6, 0.2, True)) @ np.random.default_rng(5).normal(size=(80, 3))).T
        packed = spark.createDataFrame([(i, [(j, float(t[j]), float(v)) for j, v in enumerate(row)]) for i, row in enumerate(y)], "series_id long, samples array<struct<i:int,t:double,v:double>>")
        rows = {(x.series_id, x.m): x for x in fitting.fit(packed, Axis(t, np.ones((80, 1)), -1), ["white + drifting", "white + matern32"]).collect()}
        for i in range(3):
            if rows[i, 0].outcome == rows[i, 1].outcome == 0:
                assert rows[i, 0].loglik == pytest.approx(rows[i, 1].loglik, abs=1e-4)
        assert any(rows[i, 0].outcome == 0 for i in range(3))
    finally:
        families.FAMILIES.pop("drifting")


def test_covariance_entries_and_correlations(spark):
    fits = spark.createDataFrame([(1, 0, [4.0, 1.0, 9.0, -2.0, 0.0, 1.0]), (1, 1, [2.5]), (2, 0, None), (3, 0, [])], "series_id long, m int, beta_cov array<double>")
    got = models.covariance_entries(fits, "beta_cov")
    assert {(r.series_id, r.m, r.i, r.j): r.value for r in got.collect()} == {(1, 0, 0, 0): 4.0, (1, 0, 1, 0): 1.0, (1, 0, 1, 1): 9.0, (1, 0, 2, 0): -2.0, (1, 0, 2, 1): 0.0, (1, 0, 2, 2): 1.0, (1, 1, 0, 0): 2.5}
    assert {(r.m, r.i, r.j): r.correlation for r in models.correlations_of(got).collect()} == {(0, 1, 0): pytest.approx(1 / 6), (0, 2, 0): -1.0, (0, 2, 1): 0.0}
