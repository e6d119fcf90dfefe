from __future__ import annotations

import json

import numpy as np
import pytest

from tidewright.__main__ import BAD_CONFIG, BAD_DATA, main
from tidewright.functions import design, families
from tidewright.plans.config import FIT_FIELDS, Config, ConfigError, digest, load
from tidewright.plans.runner import run
from tidewright.sources.inputs import InputError, open_long, scheme_of
from tidewright.sources.store import ResumeError, Store


@pytest.fixture(scope="module")
def grid_input(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "grid.parquet")
    rng = np.random.default_rng(0)
    rows = [(y, x, f"{2000 + m // 12}-{m % 12 + 1:02d}-01 00:00:00", float(rng.normal())) for y in range(2) for x in range(2) for m in range(60) if not (y == x == 0 and m > 5)]
    rows += [(9, 9, "2000-01-01 00:00:00", None)]
    spark.createDataFrame(rows, "y int, x int, at string, sla double").selectExpr("y", "x", "cast(at as timestamp_ntz) as ts", "sla").write.parquet(path)
    return path


def config(uri, **kw):
    base = {"data_uri": uri, "variable": "sla", "signal_terms": ["constant", "trend", "annual"], "candidates": ["white", "white + matern12"], "criteria": ["aic", "hqic"], "objective": "reml", "tile_side": 2}
    return Config(**base | kw)


def test_run_resume_and_reuse(spark, grid_input, tmp_path):
    at = str(tmp_path / "store")
    first = run(spark, config(grid_input), at)
    assert (first.n_series, first.n_fitted) == (5, 5)
    store = Store(spark, at)
    fits = {(r.series_id, r.candidate): r for r in store.table("fits").collect()}
    assert len(fits) == 10
    assert fits[(9 << 31) + 9, "white"].outcome == 10
    short = fits[0, "white"]
    assert short.outcome == 0 and short.n == 2
    best = {(r.series_id, r.criterion): r for r in store.table("selection").collect()}
    assert best[0, "hqic"].ic_best is None and best[0, "hqic"].selected == -1 and best[0, "aic"].selected >= 0  # n = 6 - 4 = 2
    assert run(spark, config(grid_input), at).n_fitted == 0
    with pytest.raises(ResumeError, match="criteria"):
        run(spark, config(grid_input, criteria=["bic"]), at)
    with pytest.raises(ResumeError, match="fit_hash"):
        run(spark, config(grid_input, signal_terms=["constant"]), at)
    other = str(tmp_path / "other")
    assert run(spark, config(grid_input, criteria=["bic"]), other, reuse_fits_from=at).n_fitted == 0
    again = {(r.series_id, r.m): r.ic_best for r in Store(spark, other).table("selection").collect()}
    assert len(again) == 10 and again[0, 0] is not None


def test_resume_goes_on_with_what_is_outstanding(spark, grid_input, tmp_path):
    at = str(tmp_path / "store")
    run(spark, config(grid_input, tile_side=1), at)
    whole = sorted(Store(spark, at).table("fits").select("series_id", "m", "loglik").collect(), key=str)
    done = Store(spark, at).table("completion").where("ty <> 1").collect()
    spark.createDataFrame(done).coalesce(1).write.mode("overwrite").parquet(f"{at}-kept")
    spark.read.parquet(f"{at}-kept").write.mode("overwrite").parquet(f"{at}/completion")
    assert run(spark, config(grid_input, tile_side=1), at).n_fitted == 2
    assert sorted(Store(spark, at).table("fits").select("series_id", "m", "loglik").collect(), key=str) == whole


def test_hashes_and_configs(tmp_path):
    payload = {"geometry_hash": "0123456789abcdef", "variable": "sla", "signal_terms": ["constant", "trend", "annual"], "objective": "ml", "engine": "kalman", "seed": 0, "registry_version": "1", "algorithm_version": "1"}
    c = config("in.parquet", objective="ml", candidates=["white+matern12"], criteria=["aic"])
    assert c.fit_hash("0123456789abcdef") == "1eb1fd731b4ae8d6"
    assert c.compat_hash("0123456789abcdef") == "d368e07b5f99efe9"
    assert set(payload) <= set(FIT_FIELDS)
    for bad in ({"candidates": ["white", " white "]}, {"criteria": ["dic"]}, {"objective": "map"}, {"criteria": []}):
        with pytest.raises(ConfigError):
            config("in.parquet", **bad)
    with pytest.raises(ConfigError):
        digest({"a": float("nan")})
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"data_uri": "a.parquet", "variable": "v", "signal_terms": ["constant"], "candidates": ["white"], "criteria": ["aic"], "extra": 1}))
    with pytest.raises(ConfigError, match="extra"):
        load(str(f))
    t = tmp_path / "c.toml"
    t.write_text('data_uri = "a.parquet"\nvariable = "v"\nsignal_terms = ["harmonic:0.5"]\ncandidates = ["white"]\ncriteria = ["aic"]\n')
    assert load(str(t)).signal_terms == ("harmonic:0.5",)


def test_refusals(spark, grid_input, tmp_path):
    for term in ("exp_decay", "offset", "harmonic:-1", "trend:3", "nothing"):
        with pytest.raises(design.SignalError):
            design.parse(term)
    with pytest.raises(families.CandidateError):
        families.register(families.FAMILIES["white"])
    with pytest.raises(InputError):
        scheme_of("s3://bucket/table.zarr")
    with pytest.raises(InputError):
        open_long(spark, grid_input, "nothing")
    assert main([str(tmp_path / "missing.toml"), "out"]) == BAD_CONFIG
    bad = tmp_path / "c.json"
    bad.write_text(json.dumps({"data_uri": grid_input, "variable": "nothing", "signal_terms": ["constant"], "candidates": ["white"], "criteria": ["aic"]}))
    assert main([str(bad), str(tmp_path / "s")]) == BAD_DATA
    with pytest.raises(SystemExit) as e:
        main([])
    assert e.value.code == BAD_CONFIG


def test_decimal_years(spark):
    from pyspark.sql import functions as F

    from tidewright.functions.timeaxis import decimal_year

    df = spark.createDataFrame([("2000-01-01",), ("2000-07-01",), ("2001-07-01",), ("2000-12-31 12:00:00",)], "s string").select(decimal_year(F.col("s").cast("timestamp_ntz")))
    assert [r[0] for r in df.collect()] == [2000.0, 2000 + 182 / 366, 2001 + 181 / 365, 2000 + 365.5 / 366]


def test_online_filter_equals_the_fold(spark, tmp_path):
    from tidewright.operators.filtering import ou_loglik
    from tidewright.operators.series import pack
    from tidewright.streaming.online import online_loglik

    rng = np.random.default_rng(3)
    rows = [(s, i, float(i) / 7, float(rng.normal())) for s in range(3) for i in range(20)]
    late = [(0, 0.5, 1.0)]
    source = str(tmp_path / "stream")
    schema = "series_id bigint, i int, t double, v double"
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).select("series_id", "t", "v").coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame(late, "series_id bigint, t double, v double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("series_id bigint, t double, v double").option("maxFilesPerTrigger", 1).parquet(source)
    q = online_loglik(stream, 0.8, 0.5, 0.6).writeStream.format("memory").queryName("online").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.series_id: r for r in spark.table("online").orderBy("n", "n_late").collect()}
    want = pack(spark.createDataFrame(rows, schema)).select("series_id", ou_loglik("samples", "0.8D", "0.5D", "0.6D").loglik.alias("l")).collect()
    for r in want:
        assert last[r.series_id].loglik == pytest.approx(r.l, abs=1e-9)
    assert last[0].n_late == 1
