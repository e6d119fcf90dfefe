from __future__ import annotations

import json
import os
import signal

import numpy as np
import pytest
from oracle import covariance, loglik
from pyspark.sql import functions as F

from tidewright.__main__ import ABORTED, BAD_CONFIG, BAD_DATA, OK, WITH_FAILURES, main
from tidewright.functions import design, families
from tidewright.functions.families import AnalyticGradientError, CandidateError, Family, Layout, gradient_mode
from tidewright.functions.statespace import DefectiveMatrixError, eigen_transition, expm, safe_transition
from tidewright.functions.transforms import Identity, Log, Logit, delta_method
from tidewright.operators import fitting, models, workloads
from tidewright.operators.counting import lag_pairs
from tidewright.operators.engines import DenseEngine, Engine, KalmanEngine
from tidewright.operators.lint import lint
from tidewright.plans import runner
from tidewright.plans.config import Config, ConfigError, spec_hash
from tidewright.sources import inputs
from tidewright.sources.store import ResumeError, Store

N = 60
T = 2000 + np.arange(N) / 12
X = np.stack([np.ones(N), T - T.mean()], 1)
AXIS = fitting.Axis(T, X, 1)


def drawn(rows, seed=5):
    return (np.linalg.cholesky(covariance(T, 0.5, 1.0, 0.2)) @ np.random.default_rng(seed).normal(size=(N, rows))).T


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "grid.parquet")
    rng = np.random.default_rng(0)
    rows = [(y, x, f"{2000 + m // 12}-{m % 12 + 1:02d}-01 00:00:00", float(rng.normal())) for y in range(3) for x in range(2) for m in range(48)]
    spark.createDataFrame(rows, "y int, x int, at string, sla double").selectExpr("y", "x", "cast(at as timestamp_ntz) as ts", "sla").write.parquet(path)
    return path


def config(uri, **kw):
    base = {"data_uri": uri, "variable": "sla", "signal_terms": ["constant", "trend"], "candidates": ["white"], "criteria": ["aic"], "tile_side": 1}
    return Config(**base | kw)


def test_maps_and_their_slopes(spark):
    u = np.linspace(-3, 3, 13)
    for b in (Identity(), Log(), Logit(-1.0, 4.0)):
        x = b.forward(u)
        np.testing.assert_allclose(b.inverse(x), u, atol=1e-9)
        slope = (b.forward(u + 1e-6) - b.forward(u - 1e-6)) / 2e-6
        np.testing.assert_allclose(b.slope(u), slope, rtol=1e-6)
        np.testing.assert_allclose(b.log_slope(u), np.log(np.abs(slope)), atol=1e-6)
        got = spark.createDataFrame([(float(v),) for v in u], "u double").select(b.forward(F.col("u")), b.inverse(b.forward(F.col("u"))), b.slope(F.col("u")), b.log_slope(F.col("u"))).collect()
        np.testing.assert_allclose(np.array(got, float), np.stack([x, u, b.slope(u), b.log_slope(u)], 1), atol=1e-9)
    with pytest.raises(ValueError):
        Logit(1.0, 1.0)
    np.testing.assert_allclose(delta_method(np.array([[2.0, 1.0], [1.0, 3.0]]), np.array([2.0, 5.0])), [[8, 10], [10, 75]])


def test_fixed_parameters_are_hydrated(spark):
    layout = Layout.of("white + matern12(rho=1.5)")
    assert layout.free_names == [("matern12[0]", "sigma"), ("white[0]", "sigma")]
    np.testing.assert_array_equal(layout.hydrate(np.array([[2.0, 3.0]])), [[2.0, 1.5, 3.0]])
    y = drawn(4)
    got = fitting.fit_batch(y, AXIS, "white + matern12(rho=1.0)", "ml", 200)
    ok = np.flatnonzero(got["outcome"] == 0)
    assert len(ok) and got["theta"].shape == (4, 2) and (got["k"][ok] == 4).all()
    for i in ok:
        assert got["loglik"][i] == pytest.approx(loglik(y[i], covariance(T, got["theta"][i, 0], 1.0, got["theta"][i, 1]), X), abs=1e-8)
    whole = fitting.fit_batch(y, AXIS, "white(sigma=0.2) + matern12(sigma=0.5, rho=1.0)", "ml", 200)
    assert (whole["outcome"] == 0).all() and whole["loglik"][0] == pytest.approx(loglik(y[0], covariance(T, 0.5, 1.0, 0.2), X), abs=1e-8)
    index = models.free_index(spark, ["white + matern12(rho=1.5)"])
    fits = spark.createDataFrame([(1, 0, [2.0, 3.0]), (2, 0, None)], "series_id long, m int, theta array<double>")
    assert {r.series_id: r.theta for r in models.hydrated(fits, index).collect()} == {1: [2.0, 1.5, 3.0], 2: None}
    assert models.parameter_table(spark, ["white + matern12(rho=1.5)"]).count() == 2
    assert len({spec_hash(c) for c in ("matern12", "matern12(rho=1.0)", "matern12(rho=2.0)")}) == 3
    for bad in ("matern12(rho)", "matern12(tau=1)", "matern12(rho=1", "matern12(rho=1, rho=2)", "matern12(rho=inf)"):
        with pytest.raises(CandidateError):
            Layout.of(bad)


def test_engines_agree_and_can_be_replaced(spark):
    y = drawn(3)
    y[0, 5:20] = np.nan
    theta = np.tile([0.7, 0.3, 0.4, 1.5, 0.2], (3, 1))
    kinds = ("matern12", "matern32", "white")
    for a, b in zip(KalmanEngine().score(y, AXIS, kinds, theta), DenseEngine().score(y, AXIS, kinds, theta), strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-8, atol=1e-8)
    assert isinstance(KalmanEngine(), Engine)

    class Broken:
        engine_id = "broken"

        def score(self, y, axis, kinds, theta):
            raise RuntimeError("this engine scores nothing")

    with pytest.raises(RuntimeError, match="scores nothing"):
        fitting.fit_batch(y, AXIS, "white", "ml", 10, engine=Broken())
    packed = spark.createDataFrame([(i, [(j, float(T[j]), float(v)) for j, v in enumerate(row) if np.isfinite(v)]) for i, row in enumerate(y)], "series_id long, samples array<struct<i:int,t:double,v:double>>")
    first = fitting.fit(packed, AXIS, ["white + matern12"], engine=DenseEngine()).collect()
    assert {r.engine for r in first} == {"dense"} and {r.objective for r in first} == {"ml"}
    warm = fitting.fit(packed, AXIS, ["white + matern12", "white"], x0=spark.createDataFrame(first)).collect()
    for a in first:
        b = next(r for r in warm if r.series_id == a.series_id and r.candidate == a.candidate)
        assert b.rung == "WARM_START" and b.iterations <= a.iterations
        if a.outcome == b.outcome == 0:
            assert b.loglik == pytest.approx(a.loglik, abs=1e-5)
    assert {r.rung for r in warm if r.candidate == "white"} <= {"MOMENT", "CLIPPED", "DEFAULT"}
    with pytest.raises(ValueError):
        fitting.fit_batch(y, AXIS, "white", "ml", 10, x0=np.zeros((3, 2)))


def test_families_of_the_caller_reach_the_workers(spark):
    own = Family("twice_white", ("sigma",), 0, families.FAMILIES["white"].acvf, covariance=lambda lag, s: np.where(lag == 0, s * s, 0.0))
    families.register(own)
    try:
        packed = spark.createDataFrame([(i, [(j, float(T[j]), float(v)) for j, v in enumerate(row)]) for i, row in enumerate(drawn(2))], "series_id long, samples array<struct<i:int,t:double,v:double>>")
        rows = {(r.series_id, r.candidate): r for r in fitting.fit(packed, AXIS, ["twice_white", "white"]).collect()}
        assert rows[0, "twice_white"].loglik == pytest.approx(rows[0, "white"].loglik, abs=1e-6)
        assert rows[0, "twice_white"].n_eff_bic == pytest.approx(N)
        lost = Family("silent", ("sigma",), 0, families.FAMILIES["white"].acvf)
        families.register(lost)
        with pytest.raises(ValueError, match="no autocovariance"):
            fitting.correlations(("silent",), np.array([1.0]), np.zeros(1))
    finally:
        families.FAMILIES.pop("twice_white")
        families.FAMILIES.pop("silent", None)


def test_derivatives_and_gradient_modes(spark):
    f, s, r, dt, h = families.FAMILIES["matern12"], np.array([0.7, 2.0]), np.array([0.4, 3.0]), 0.3, 1e-6
    trans, noise = f.dstep(s, r, dt)
    for j, (up, down) in enumerate((((s + h, r), (s - h, r)), ((s, r + h), (s, r - h)))):
        for got, k in ((trans, 0), (noise, 1)):
            np.testing.assert_allclose(got[j], (f.step(*up, dt)[k] - f.step(*down, dt)[k]) / (2 * h), rtol=1e-6, atol=1e-9)
        np.testing.assert_allclose(f.dstationary(s, r)[j], (f.stationary(*up) - f.stationary(*down)) / (2 * h), rtol=1e-6, atol=1e-9)
    assert [gradient_mode(c, o) for c, o in (("matern12", "ml"), ("matern12", "reml"), ("white + matern12", "ml"))] == ["analytic", "finite_difference", "finite_difference"]
    assert [r.mode for r in models.gradient_modes(spark, ["matern12 + matern12", "matern32"], "ml").orderBy("m").collect()] == ["analytic", "finite_difference"]
    with pytest.raises(AnalyticGradientError):
        gradient_mode("white", "ml", [Family("claims", ("sigma",), 1, lambda lag, s: lag, analytic=("ml",))])
    with pytest.raises(ValueError):
        fitting.as_point(np.zeros((1, 2)))


def test_transitions_of_any_drift():
    a = np.array([[0.0, 1.0], [-2.0, -3.0]])
    lam, v = np.linalg.eig(a)
    want = (v * np.exp(lam * 0.7) @ np.linalg.inv(v)).real
    np.testing.assert_allclose(eigen_transition(a, 0.7), want, atol=1e-12)
    np.testing.assert_allclose(expm(a * 0.7), want, atol=1e-12)
    defective = np.array([[-1.0, 1.0], [0.0, -1.0]])
    with pytest.raises(DefectiveMatrixError):
        eigen_transition(defective, 0.5)
    got, fallbacks = safe_transition(defective, 0.5)
    assert fallbacks == 1 and safe_transition(a, 0.5)[1] == 0
    np.testing.assert_allclose(got, np.exp(-0.5) * np.array([[1, 0.5], [0, 1]]), atol=1e-12)


def test_rank_and_size_of_the_design():
    there = np.ones((4, N), bool)
    there[1, 1:] = False
    there[2, 30:] = False
    there[3] = False
    rank, condition, logdet = fitting.design_ranks(there, X)
    assert rank.tolist() == [2, 1, 2, 0] and condition[1] > 1e12
    for i in (0, 2):
        assert logdet[i] == pytest.approx(np.linalg.slogdet(X[there[i]].T @ X[there[i]])[1], abs=1e-9)
    assert logdet[3] == -np.inf
    # Columns that differ by 1e-6 of their size are told apart, which the Gram matrix's own rounding would hide.
    near = np.stack([np.ones(N), 1 + 1e-6 * (T - T.mean())], 1)
    assert fitting.design_ranks(np.ones((1, N), bool), near)[0][0] == 2
    assert fitting.whitened_rank(np.array([np.eye(2), np.ones((2, 2))])).tolist() == [2, 1]
    with pytest.raises(fitting.DesignError):
        fitting.check_design(np.zeros((2, N - 1)), AXIS)
    with pytest.raises(fitting.DesignError):
        fitting.check_design(np.zeros((2, N)), fitting.Axis(T, np.full((N, 1), np.nan), -1))


def test_loglik_facades():
    y = drawn(2)
    theta = np.array([0.5, 1.0, 0.2])
    for kw in ({}, {"objective": "reml"}):
        got = fitting.loglik(y, AXIS, "white + matern12", theta, **kw)
        for i in range(2):
            assert got[i] == pytest.approx(loglik(y[i], covariance(T, *theta), X, bool(kw)), abs=1e-8)
        np.testing.assert_allclose(fitting.unconstrained_loglik(y, AXIS, "white + matern12", np.log(theta), **kw), got)


def test_squared_correlations_by_lag_and_in_blocks():
    kinds, theta = ("matern12", "white"), np.array([0.5, 1.0, 0.3])
    on = np.random.default_rng(1).random(N) < 0.7
    for t in (T, np.sort(2000 + 5 * np.random.default_rng(2).random(N))):
        lag = t[on][:, None] - t[on][None, :]
        want = (fitting.correlations(kinds, theta, lag)[0] ** 2).sum()
        for block in (7, 512):
            assert fitting.squared_correlations(on, t, kinds, theta, block) == pytest.approx(want, rel=1e-9)


def test_lag_pairs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    places = {s: sorted(rng.choice(40, 17, replace=False).tolist()) for s in range(3)}
    df = spark.createDataFrame([(s, i) for s, at in places.items() for i in at], "series_id long, i int")
    got = {(r.series_id, r.lag): r.pairs for r in lag_pairs(df).collect()}
    want = {}
    for s, at in places.items():
        for a in at:
            for b in at:
                if b >= a:
                    want[s, b - a] = want.get((s, b - a), 0) + 1
    assert got == want


def test_regressors(spark, table, tmp_path):
    from tidewright.operators.series import axis

    long = inputs.open_long(spark, table, "sla")
    a = axis(long)
    extra = long.select("ts").distinct().withColumn("enso", F.month("ts") * 0.5)
    plan = fitting.planned(a.join(extra, "ts"), ["constant", "regressor:enso", "trend"])
    assert plan.trend == 2 and plan.x[:, 1].tolist() == [(i % 12 + 1) * 0.5 for i in range(48)]
    assert fitting.column_terms(["annual", "trend"]) == ["annual", "annual", "trend"] and fitting.k_beta(["annual", "trend"]) == 3
    with pytest.raises(design.SignalError, match="enso"):
        fitting.planned(a, ["regressor:enso"])
    with pytest.raises(design.SignalError, match="no number"):
        fitting.planned(a.join(extra.where("month(ts) <> 3"), "ts", "left"), ["regressor:enso"])
    with pytest.raises(design.SignalError, match="more than 5 times"):
        fitting.planned(a, ["constant"], most=5)
    assert runner.run(spark, config(table, signal_terms=["constant", "regressor:enso"]), str(tmp_path / "s"), regressors=extra).n_fitted == 6
    with pytest.raises(design.SignalError):
        config(table, signal_terms=["constant", "regressor_field:wind"])
    assert design.per_point(["constant", "regressor_field:wind"]) == ["wind"]


def test_fits_are_executed_once_and_tiles_committed_one_by_one(spark, table, tmp_path, monkeypatch):
    calls, at = spark.sparkContext.accumulator(0), str(tmp_path / "s")
    plain = fitting.fit

    def counted(*a, **kw):
        def count(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        df = plain(*a, **kw)
        return df.mapInArrow(count, df.schema)

    monkeypatch.setattr(fitting, "fit", counted)
    seen = []
    report = runner.run(spark, config(table), at, tiles_per_commit=2, on_tiles_written=lambda tiles: seen.append((tiles, Store(spark, at).table("completion").count())))
    assert (report.n_fitted, report.n_tiles, calls.value) == (6, 6, 6)
    assert seen == [([(0, 0), (0, 1)], 2), ([(1, 0), (1, 1)], 4), ([(2, 0), (2, 1)], 6)]
    store = Store(spark, at)
    assert store.tiled_tables() == ["fits", "selection", "points"]
    assert [r.label for r in store.table("dim_model").collect()] == ["white"] and store.table("dim_series").count() == 6
    assert sorted(r.y for r in store.table("dim_y").collect()) == [0, 1, 2] and [r.criterion for r in store.table("dim_criterion").collect()] == ["aic"]
    assert {(r.objective, r.engine) for r in store.table("fits").collect()} == {("ml", "kalman")}


def test_a_run_that_is_stopped_goes_on(spark, table, tmp_path):
    at = str(tmp_path / "s")
    first = runner.run(spark, config(table), at, tiles_per_commit=2, on_tiles_written=lambda tiles: os.kill(os.getpid(), signal.SIGTERM))
    assert first.stopped and first.n_tiles == 2 and Store(spark, at).table("completion").count() == 2
    again = runner.run(spark, config(table), at, tiles_per_commit=2)
    assert not again.stopped and again.n_fitted == 4 and Store(spark, at).table("fits").count() == 6
    assert signal.getsignal(signal.SIGTERM) in (signal.SIG_DFL, signal.default_int_handler) or callable(signal.getsignal(signal.SIGTERM))


def test_a_run_that_is_lost_refits_only_what_is_open(spark, table, tmp_path):
    at = str(tmp_path / "s")

    class Lost(Exception):
        pass

    def lose(tiles):
        if tiles == [(1, 0), (1, 1)]:
            raise Lost

    with pytest.raises(Lost):
        runner.run(spark, config(table), at, tiles_per_commit=2, on_tiles_written=lose)
    assert runner.run(spark, config(table), at, tiles_per_commit=2).n_fitted == 2


def test_stores_of_other_runs_are_refused_in_words(spark, table, tmp_path):
    at = str(tmp_path / "s")
    runner.run(spark, config(table, tile_side=2), at)
    with pytest.raises(ResumeError, match="side 2"):
        runner.run(spark, config(table, tile_side=1), at)
    assert runner.run(spark, config(table, tile_side=4), at).n_fitted == 0
    fewer = str(tmp_path / "fewer.parquet")
    spark.read.parquet(table).where("y < 2").write.parquet(fewer)
    with pytest.raises(ResumeError, match="n_series differs: the store was written with 6, and this input has 4"):
        runner.run(spark, config(fewer, tile_side=2), at)
    g = inputs.geometry(inputs.open_long(spark, table, "sla"), "sla")
    assert inputs.describe_mismatch(g, g) is None and "times" in inputs.describe_mismatch(g, g | {"times": 1}) and inputs.geometry_hash(inputs.open_long(spark, table, "sla"), "sla") == inputs.digest(g)
    with pytest.raises(ResumeError, match="needs"):
        Store(spark, str(tmp_path / "t")).create({"fit_hash": "x"})
    reml = str(tmp_path / "r")
    runner.run(spark, config(table, objective="reml"), reml)
    assert {r.objective for r in Store(spark, reml).table("fits").collect()} == {"reml"}


def test_times_that_do_not_increase_are_refused(spark, table, tmp_path):
    twice, none = str(tmp_path / "twice.parquet"), str(tmp_path / "none.parquet")
    df = spark.read.parquet(table)
    df.union(df.where("y = 1 and x = 0").limit(1).withColumn("sla", F.lit(9.0))).write.parquet(twice)
    df.withColumn("ts", F.when(F.col("y") != 1, F.col("ts"))).write.parquet(none)
    for uri in (twice, none):
        with pytest.raises(inputs.InputError):
            inputs.checked(inputs.open_long(spark, uri, "sla"))
        with pytest.raises(inputs.InputError):
            runner.run(spark, config(uri), str(tmp_path / "out"))
    with pytest.raises(inputs.InputError, match="nowhere.parquet could not be opened"):
        inputs.open_long(spark, str(tmp_path / "nowhere.parquet"), "sla")
    got = inputs.report(spark, table, "sla")
    assert (got.n_time, got.n_series, got.dtype, got.calendar, got.units) == (48, 6, "double", "proleptic_gregorian", None) and len(got.unique_dt) == 6  # 28, 30 and 31 days of 365, and 29, 30 and 31 of 366
    named = df.withMetadata("sla", {"units": "m"})
    assert inputs.source_units(named, "sla") == "m" and inputs.source_units(named.withMetadata("sla", {"units": "m", "encoding_units": "mm"}), "sla") == "mm"


def test_exit_codes(spark, table, tmp_path, monkeypatch):
    c = tmp_path / "c.json"
    base = {"data_uri": table, "variable": "sla", "signal_terms": ["constant"], "candidates": ["white"], "criteria": ["aic"], "tile_side": 1}
    c.write_text(json.dumps(base))
    assert main([str(c), str(tmp_path / "ok")]) == OK
    c.write_text(json.dumps(base | {"max_iter": 1, "candidates": ["white", "white + matern32"]}))
    assert main([str(c), str(tmp_path / "cap"), "--max-failure-rate", "0.5"]) == WITH_FAILURES
    assert main([str(c), str(tmp_path / "cap")]) == OK
    c.write_text(json.dumps(base | {"engine": "none"}))
    assert main([str(c), str(tmp_path / "e")]) == BAD_CONFIG
    c.write_text(json.dumps(base | {"data_uri": str(tmp_path / "gone.parquet")}))
    assert main([str(c), str(tmp_path / "e")]) == BAD_DATA
    c.write_text(json.dumps(base))
    plain = Store.write_tiles

    def stopped(self, *a):
        plain(self, *a)
        os.kill(os.getpid(), signal.SIGTERM)

    monkeypatch.setattr(Store, "write_tiles", stopped)
    assert main([str(c), str(tmp_path / "stop"), "--tiles-per-commit", "2"]) == ABORTED
    with pytest.raises(ConfigError):
        config(table, objective="x")


def test_terms_that_cannot_be_linted_are_named():
    rules = lambda c, **kw: [f.rule for f in lint(c, 0.1, **kw)]
    assert rules("unheard") == ["not_lintable"] and rules("white + unheard") == ["not_lintable"]
    families.register(Family("stateful", ("sigma",), 2, lambda lag, s: lag))
    try:
        assert rules("stateful") == ["not_lintable"]
    finally:
        families.FAMILIES.pop("stateful")
    assert rules("matern12(rho=1.0) + matern12(rho=1.4)") == ["same_kind_pinned_overlap"]


def test_ragged_blocks_and_workloads(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 1, 2)], "v array<double>, o long, e long")
    assert df.select(models.block(F.col("v"), F.col("o"), F.col("e"))).first()[0] == [2.0, 3.0]
    assert workloads.model(3) == "white + matern12 + matern32" and len(workloads.true_parameters(3)) == 5
    with pytest.raises(ValueError):
        workloads.model(2)
    packed = workloads.drawn(spark, 1, 60, rows=30)
    assert packed.count() == 30 and {tuple(map(tuple, r.samples)) for r in packed.collect()} == {tuple(map(tuple, r.samples)) for r in packed.repartition(3).collect()}
    sizes = {case: [len(r.samples) for r in workloads.with_gaps(packed, case, 60).collect()] for case in workloads.GAP_CASES}
    assert set(sizes["none"]) == {60} and set(sizes["contiguous_40"]) == {36} and 50 < np.mean(sizes["scattered_10"]) < 57
    with pytest.raises(ValueError):
        workloads.with_gaps(packed, "some", 60)
    t = np.arange(60) / 12
    fits = fitting.fit(packed, fitting.Axis(t, np.ones((60, 1)), -1), [workloads.model(1)])
    got = workloads.iteration_statistics(fits).first()
    rows = [r.iterations for r in fits.collect() if r.outcome == 0]
    assert (got.n_sample, got.n_ok, got.max_iterations) == (30, len(rows), max(rows)) and got.mean_iterations == pytest.approx(np.mean(rows)) and 0 < got.utilization <= 1
