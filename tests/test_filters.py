from __future__ import annotations

import numpy as np
import pytest
from oracle import covariance, loglik
from pyspark.sql import functions as F

from tidewright.operators import gls
from tidewright.operators.filtering import augmented, matern32_loglik, ou_loglik, white_loglik

T = np.array([0, 0.3, 0.5, 1.2, 1.25, 2.0, 2.9, 3.0, 4.4, 5.0])
Y = np.random.default_rng(0).normal(size=10)


@pytest.fixture(scope="module")
def packed(spark):
    rows = [(1, [(i, float(t), float(v), float(t - T.mean())) for i, (t, v) in enumerate(zip(T, Y, strict=True))])]
    return spark.createDataFrame(rows, "series_id bigint, samples array<struct<i:int,t:double,v:double,c:double>>")


def test_white(packed):
    assert packed.select(white_loglik("samples", "0.7D").loglik).first()[0] == pytest.approx(loglik(Y, covariance(T, 0, 1, 0.7)), abs=1e-9)


@pytest.mark.parametrize("tau", [0.0, 0.6])
def test_ou(packed, tau):
    got = packed.select(ou_loglik("samples", "0.8D", "0.5D", f"{tau}D").alias("r")).first().r
    assert got.loglik == pytest.approx(loglik(Y, covariance(T, 0.8, 0.5, tau)), abs=1e-9)
    assert got.ok and got.n == 10


@pytest.mark.parametrize("rho", [0.1, 0.4, 30.0])
def test_matern32(packed, rho):
    got = packed.select(matern32_loglik("samples", "0.8D", f"{rho}D", "0.6D").loglik).first()[0]
    assert got == pytest.approx(loglik(Y, covariance(T, 0.8, rho, 0.6, True)), abs=1e-8)


def test_gaps_and_empty_series(spark, packed):
    gapped = packed.withColumn("samples", F.transform("samples", lambda e: F.struct(e["t"].alias("t"), F.when(e["i"] % 3 != 1, e["v"]).alias("v"))))
    on = np.arange(10) % 3 != 1
    got = gapped.select(ou_loglik("samples", "0.8D", "0.5D", "0.6D").alias("r")).first().r
    assert got.loglik == pytest.approx(loglik(Y[on], covariance(T[on], 0.8, 0.5, 0.6)), abs=1e-9)
    none = packed.withColumn("samples", F.filter("samples", lambda e: e["i"] > 99))
    assert none.select(ou_loglik("samples", "0.8D", "0.5D", "0.6D").alias("r")).first().r.ok is False


def test_duplicate_times(spark):
    t, y = np.array([0, 0, 1, 2.5, 2.5, 4.0]), np.random.default_rng(11).normal(size=6)
    df = spark.createDataFrame([([(float(a), float(b)) for a, b in zip(t, y, strict=True)],)], "samples array<struct<t:double,v:double>>")
    assert df.select(ou_loglik("samples", "0.8D", "0.5D", "0.6D").loglik).first()[0] == pytest.approx(loglik(y, covariance(t, 0.8, 0.5, 0.6)), abs=1e-9)


def test_gls_and_reml(packed):
    r = packed.withColumn("r", augmented("samples", ["1D", "e.c"], "0.8D", "0.5D", "0.6D"))
    at = lambda i, j: F.get("r.a", F.lit(3 * i + j))
    n = r.select("samples", "r.n", "r.logdet", at(0, 0).alias("y0"), at(0, 1).alias("y1"), at(0, 2).alias("y2"), at(1, 1).alias("g11"), at(1, 2).alias("g12"), at(2, 2).alias("g22"))
    x, cov = np.stack([np.ones(10), T - T.mean()], 1), covariance(T, 0.8, 0.5, 0.6)
    solved = gls.solve_two(n).withColumns({"h11": F.lit(10.0), "h12": F.lit(float(x[:, 1].sum())), "h22": F.lit(float((x[:, 1] ** 2).sum()))})
    got = gls.restricted(solved).first()
    assert got.loglik == pytest.approx(loglik(Y, cov, x), abs=1e-9)
    assert got.reml == pytest.approx(loglik(Y, cov, x, True), abs=1e-9)
    assert got.outcome == 0
    beta = np.linalg.solve(x.T @ np.linalg.inv(cov) @ x, x.T @ np.linalg.inv(cov) @ Y)
    assert [got.b0, got.b1] == pytest.approx(beta.tolist(), abs=1e-9)
