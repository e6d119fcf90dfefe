from __future__ import annotations

import json
import os
import signal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import fitting
from tidewright.plans import runner
from tidewright.plans.config import Config
from tidewright.sources.store import Packed, Store


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    """3 by 5 series, with empty rows of tiles between them, and gaps."""
    path = str(tmp_path_factory.mktemp("in") / "grid.parquet")
    rng = np.random.default_rng(1)
    rows = [(y, x, f"{2000 + m // 12}-{m % 12 + 1:02d}-01 00:00:00", float(rng.normal()) if m % 7 != x else None) for y in (3, 4, 9) for x in range(5) for m in range(30)]
    spark.createDataFrame(rows, "y int, x int, at string, sla double").selectExpr("y", "x", "cast(at as timestamp_ntz) as ts", "sla").write.parquet(path)
    return path


def config(uri, **kw):
    return Config(**{"data_uri": uri, "variable": "sla", "signal_terms": ["constant", "trend"], "candidates": ["white", "white + matern12"], "criteria": ["aic"], "tile_side": 2} | kw)


def test_a_commit_reads_the_folder_of_its_unit_and_each_series_once(spark, grid, tmp_path, monkeypatch):
    at, files = str(tmp_path / "s"), []
    plain = Packed.read

    def read(self, unit, tiles):
        df = plain(self, unit, tiles)
        files.append((unit, {f.rpartition("/packed/")[2].partition("/")[0] for f in df.inputFiles()}))
        return df

    monkeypatch.setattr(Packed, "read", read)
    report = runner.run(spark, config(grid), at, tiles_per_commit=2)
    store = Store(spark, at)
    commits = store.table("commits").orderBy("at").collect()
    assert report.n_fitted == report.n_series == 15 and report.n_tiles == 9
    assert [c.at for c in commits] == list(range(len(commits))) and [c.unit for c in commits] == sorted({c.unit for c in commits})
    assert files == [(c.unit, {f"unit={c.unit}"}) for c in commits]
    assert [c.n_read for c in commits] == [c.n_series for c in commits] and sum(c.n_read for c in commits) == 15
    assert sum(c.n_samples for c in commits) == spark.read.parquet(grid).where("sla is not null").count()
    assert max(c.n_tiles for c in commits) <= 2 and not store.exists("packed")
    placed = {(r.series_id, r.ty, r.tx) for r in store.table("fits").where("m = 0").collect()}
    assert placed == {((y << 31) + x, y // 2, x // 2) for y in (3, 4, 9) for x in range(5)}


def test_what_is_open_of_a_unit_alone_is_fitted(spark, grid, tmp_path):
    """Tiles of a unit that are complete are not read into the next fit, and another number of tiles for a commit goes on with the rest."""
    at = str(tmp_path / "s")
    runner.run(spark, config(grid), at, tiles_per_commit=3, on_tiles_written=lambda tiles: os.kill(os.getpid(), signal.SIGTERM))
    done = Store(spark, at).table("completion").count()
    assert done == 3 and not Store(spark, at).exists("packed")
    again = runner.run(spark, config(grid), at, tiles_per_commit=4)
    commits = Store(spark, at).table("commits").orderBy("at").collect()
    assert again.n_tiles == 6 and again.n_fitted == 15 - commits[0].n_series and [c.n_read for c in commits] == [c.n_series for c in commits]
    assert Store(spark, at).table("fits").count() == 30


def test_packed_series_are_gone_after_a_refusal(spark, grid, tmp_path):
    at = str(tmp_path / "s")
    twice = str(tmp_path / "twice.parquet")
    df = spark.read.parquet(grid)
    df.union(df.where("y = 3 and x = 0 and sla is null").limit(1)).write.parquet(twice)  # a gap that is there twice
    with pytest.raises(runner.InputError, match="two samples at one time"):
        runner.run(spark, config(twice), at)
    assert not Store(spark, at).exists("packed") and Store(spark, at).provenance() is None


def test_accumulation_over_commits(spark, grid, tmp_path):
    at = str(tmp_path / "s")
    runner.run(spark, config(grid, candidates=["white"]), at, tiles_per_commit=1)
    store = Store(spark, at)
    (got,) = store.accumulation().collect()
    spark.read.parquet(f"{at}/commits").createOrReplaceTempView("commits_of_a_run")
    want = spark.sql("with c as (select cast(at as double) as at, seconds / n_series as cost from commits_of_a_run) select regr_slope(cost, at) as slope, regr_intercept(cost, at) as intercept, count(*) as n from c").first()
    assert got.n == want.n == 9 and got.slope == pytest.approx(want.slope) and got.intercept == pytest.approx(want.intercept)
    rows = store.table("commits").collect()
    x, cost = np.array([r.at for r in rows], float), np.array([r.seconds / r.n_series for r in rows])
    rest = cost - np.polyval(np.polyfit(x, cost, 1), x)
    assert got.half_difference == pytest.approx(rest[x > x.mean()].mean() - rest[x <= x.mean()].mean(), abs=1e-9)
    assert store.accumulation("n_samples").first().n == 9


def test_covariances_are_kept_as_lower_triangles(spark, grid, tmp_path):
    at = str(tmp_path / "s")
    runner.run(spark, config(grid), at)
    fits = Store(spark, at).table("fits").where("outcome = 0").collect()
    assert fits
    for r in fits:
        assert len(r.beta_cov) == 3 and len(r.theta_cov) == len(r.theta) * (len(r.theta) + 1) // 2
        assert np.sqrt([r.beta_cov[0], r.beta_cov[2]]) == pytest.approx(r.beta_err)
        assert [np.sqrt(max(r.theta_cov[i * (i + 3) // 2], 0)) for i in range(len(r.theta))] == pytest.approx(r.theta_err)
    assert Store(spark, at).table("fits").where("outcome <> 0 and (beta_cov is not null or theta_cov is not null)").count() == 0
    assert json.loads(spark.read.text(f"{at}/provenance").first()[0])["schema_version"] == 3


def test_columns_go_with_their_series(spark, grid):
    from tidewright.operators.series import axis, indexed, pack
    from tidewright.sources.inputs import open_long

    long = open_long(spark, grid, "sla")
    a = axis(long)
    packed = pack(indexed(long, a)).withColumn("note", F.concat(F.lit("n"), F.col("series_id")))
    got = fitting.fit(packed, fitting.planned(a, ["constant"]), ["white"], carry=("note",), rows_per_batch=4).collect()
    assert len(got) == 15 and all(r.note == f"n{r.series_id}" for r in got)


def test_a_store_tells_what_made_it_and_which_candidates_differ(spark, grid, tmp_path):
    from tidewright.sources.store import ResumeError

    at = str(tmp_path / "s")
    runner.run(spark, config(grid, candidates=["white"]), at)
    p = Store(spark, at).provenance()
    assert set(p["versions"]) == {"tidewright", "spark", "numpy", "pyarrow", "python", "algorithm", "registry"} and p["versions"]["spark"] == spark.version
    assert p["created_at"].endswith("+00:00") and p["n_series"] == 15 and p["gradients"] == {"white": "analytic"} and p["families"] == {"white": {"params": ["sigma"], "states": 0}}
    assert runner.run(spark, config(grid, candidates=["white"]), at).n_fitted == 0  # of another time, and goes on
    store = Store(spark, at)
    attrs = {**p, "candidates": ["x", p["candidates"][0]], "labels": ["matern12", "white"]}
    with pytest.raises(ResumeError, match="candidate 0 was white and is matern12, candidate 1 was none and is white"):
        store.check(attrs)
