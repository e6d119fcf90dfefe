from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewright.operators import models


def test_ragged_offsets_labels_and_slots(spark):
    p = models.parameter_table(spark, ["white", "white + matern12", "matern32 + matern12"])
    assert [tuple(r) for r in p.where("m = 1").orderBy("place").select("model", "term", "name").collect()] == [("matern12[0] + white[0]", "matern12[0]", "sigma"), ("matern12[0] + white[0]", "matern12[0]", "rho"), ("matern12[0] + white[0]", "white[0]", "sigma")]
    got = [tuple(r) for r in models.ragged_index(p).orderBy("m").select("extent", "offset", "cov_extent", "cov_offset").collect()]
    assert got == [(1, 0, 1, 0), (3, 1, 6, 1), (4, 4, 10, 7)]
    slots = spark.range(1).select(models.covariance_slots(F.lit(3)).alias("s"), models.covariance_slots(F.lit(0)).alias("none")).first()
    assert [tuple(x) for x in slots.s] == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)] and slots.none == []


def test_capabilities_and_resumption(spark):
    p = models.parameter_table(spark, ["white", "white + matern12"])
    assert sorted(tuple(r) for r in models.capabilities(p).collect()) == [(0, "kalman", 0), (1, "kalman", 1)]
    fast = {"white": {"kalman": 0, "toeplitz": 2}, "matern12": {"kalman": 1}}
    assert sorted(tuple(r) for r in models.capabilities(p, fast).collect()) == [(0, "kalman", 0), (0, "toeplitz", 2), (1, "kalman", 1)]
    with pytest.raises(models.IncompatibleSpecError):
        models.check_capable(p, "toeplitz")
    lists = lambda *h: spark.createDataFrame(list(enumerate(h)), "m int, hash string")
    got = models.resume_differences(lists("a", "b"), lists("a", "c", "d")).orderBy("m").collect()
    assert [tuple(r) for r in got] == [(1, "b", "c"), (2, None, "d")]
