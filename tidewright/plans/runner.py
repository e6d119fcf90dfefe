"""A whole run: configuration, input checks, fits of what is outstanding, and the store."""

from __future__ import annotations

import platform
import signal
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

import tidewright
from tidewright.functions.families import FAMILIES, Layout
from tidewright.functions.outcomes import is_eligible, is_failure
from tidewright.operators import fitting, gradients, lineage
from tidewright.operators.engines import ENGINES, Engine
from tidewright.operators.lint import lint
from tidewright.operators.series import axis_of, calendar_in, present
from tidewright.plans.config import ALGORITHM_VERSION, REGISTRY_VERSION, Config, ConfigError, digest, spec_hash
from tidewright.sources.inputs import InputError, geometry_of, open_long
from tidewright.sources.store import Packed, Store

TILES_PER_COMMIT = 64
SAMPLES = "array<struct<i:int,t:double,v:double>>"


@dataclass
class Termination:
    """Whether a run was asked to stop, and whether anything listens for that."""

    received: bool = False
    armed: bool = False


@contextmanager
def stop_on_sigterm() -> Iterator[Termination]:
    """Records SIGTERM for the duration of the block, so that what is being written is finished; later signals are recorded too."""
    state = Termination()
    try:
        former = signal.signal(signal.SIGTERM, lambda *_: setattr(state, "received", True))
    except ValueError:  # not the main thread: nothing listens, and the record says so
        yield state
        return
    state.armed = True
    try:
        yield state
    finally:
        signal.signal(signal.SIGTERM, former)


@dataclass(frozen=True)
class Report:
    """What a run did."""

    n_series: int
    n_fitted: int
    fit_hash: str
    warnings: tuple[str, ...]
    n_tiles: int = 0
    stopped: bool = False
    failure_rates: dict[str, float] = field(default_factory=dict)


def attributes(config: Config, geometry: dict, tile_side: int | None = None) -> dict:
    key = digest(geometry)
    return {
        "fit_hash": config.fit_hash(key), "compat_hash": config.compat_hash(key), "run_hash": config.run_hash(key), "geometry_hash": key, "geometry": geometry, "objective": config.objective, "engine": config.engine,
        "tile_side": tile_side or config.tile_side, "candidates": [spec_hash(c) for c in config.candidates], "labels": list(config.candidates), "criteria": list(config.criteria), "signal_terms": list(config.signal_terms),
    }


def origin(spark: SparkSession, config: Config, n_series: int) -> dict:
    """What made a store, and when: nothing of it decides whether a run may go on with it."""
    versions = {"tidewright": tidewright.__version__, "spark": spark.version, "numpy": np.__version__, "pyarrow": pa.__version__, "python": platform.python_version(), "algorithm": ALGORITHM_VERSION, "registry": REGISTRY_VERSION}
    terms = {k: {"params": list(f.params), "states": f.dim} for c in config.candidates for k in Layout.of(c).kinds if (f := FAMILIES[k])}
    return {
        "versions": versions, "created_at": datetime.now(UTC).isoformat(timespec="seconds"), "n_series": n_series, "variable": config.variable, "seed": config.seed, "max_iter": config.max_iter, "warm_start": config.warm_start,
        "gradients": {c: gradients.verified(c, config.objective) for c in config.candidates} if config.engine == "kalman" else {}, "families": terms,
    }


def kept(df: DataFrame) -> DataFrame:
    """A small table that is used several times, once computed."""
    try:
        return lineage.kept(df)
    except lineage.NoSharedFolder as e:
        raise ConfigError(str(e)) from None


def packed_places(long: DataFrame, a: DataFrame) -> DataFrame:
    """(series_id, y, x, samples, n_rows, n_times): one shuffle packs the samples and shows times that a series has twice.

    A row of ``long`` is a sample or, without a value, the place of a gap alone; its place travels once.
    """
    at = long.join(a.select("ts", "i", "t"), "ts")
    there = present(F.col("v"))
    sample = F.when(there, F.struct(F.col("i").cast("int").alias("i"), "t", F.col("v").cast("double").alias("v")))
    rows = at.groupBy("series_id", "y", "x").agg(F.array_sort(F.collect_list(sample)).cast(SAMPLES).alias("samples"), F.collect_list(F.when(~there, F.col("i").cast("int"))).alias("gaps"))
    places = F.array_distinct(F.concat(F.transform("samples", lambda s: s["i"]), "gaps"))
    return rows.select("series_id", "y", "x", "samples", (F.size("samples") + F.size("gaps")).alias("n_rows"), F.size(places).alias("n_times"))


def run(
    spark: SparkSession, config: Config, output: str | None = None, reuse_fits_from: str | None = None, regressors: DataFrame | None = None, engine: Engine | None = None,
    x0: DataFrame | None = None, tiles_per_commit: int = TILES_PER_COMMIT, on_tiles_written: Callable[[list[tuple[int, int]]], None] | None = None,
) -> Report:
    """Fits all series of the input that the store has not, or ranks another store's fits by this run's criteria.

    The input is scanned once for its times and once to pack its series, which are written by unit: tiles in a row that
    are committed together.  A commit reads the folder of its unit alone, so a run reads the packed series once.  Between
    commits a SIGTERM that has come stops the run, and the same run goes on.  What each commit read and took is a row of
    the store's table ``commits``.
    ``regressors`` (ts, and a column for each ``regressor:name``) join the time axis; ``x0`` starts fits from others.
    """
    if config.per_point_regressors:
        raise ConfigError(f"regressor fields are not fitted: {', '.join(config.per_point_regressors)}")
    if engine is None:
        if config.engine not in ENGINES:
            raise ConfigError(f"unknown engine {config.engine!r}; known: {', '.join(sorted(ENGINES))}")
        engine = ENGINES[config.engine]
    long = open_long(spark, config.data_uri, config.variable)
    seen = Observation()
    extent = [F.count_if(F.col("ts").isNull()).alias("timeless"), *(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("y", "x"))]
    a = kept(axis_of(long.observe(seen, *extent).select("ts").where("ts is not null").distinct(), calendar_in(long)))
    facts = seen.get
    if facts["timeless"]:
        raise InputError("there are samples without a time")
    steps = a.agg(F.count("*").alias("n"), F.median("dt").alias("median_dt")).first()
    if steps.n < 2:
        raise InputError(f"the time axis has {steps.n} times")
    series = packed_places(long, a)
    warnings = tuple(f.message for c in config.candidates for f in lint(c, steps.median_dt))
    store = Store(spark, output or config.output)
    side = config.tile_side if reuse_fits_from or store.provenance() is None else store.tile_side(config.tile_side)
    packed = Packed(store, side, tiles_per_commit, facts)
    try:
        if reuse_fits_from:
            places = kept(series.drop("samples"))
        else:
            packed.write(series)
            places = packed.places()
        if twice := places.where("n_times < n_rows").select("series_id").limit(1).collect():
            raise InputError(f"series {twice[0].series_id} has two samples at one time; times of a series increase")
        places = places.select("series_id", "y", "x")
        n_series = places.count()
        if n_series > places.select("series_id").distinct().count():
            raise InputError("a series is at two places")
        attrs = attributes(config, geometry_of(places, a.select("ts"), config.variable, calendar_in(long)))
        if reuse_fits_from:
            source = Store(spark, reuse_fits_from)
            source.check(attrs | {k: source.provenance()[k] for k in ("criteria", "compat_hash")})
            store.create(attrs | origin(spark, config, n_series))
            store.write_places(places)
            store.reuse(source, config.criteria)
            return Report(n_series, 0, attrs["fit_hash"], warnings, failure_rates=failure_rates(store, config))
        if store.provenance() is None:
            store.create(attrs | origin(spark, config, n_series))
            store.write_places(places)
        else:
            store.check(attrs)
        design_axis = a if regressors is None else a.join(regressors.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", "left_outer")
        tiles = kept(packed.outstanding())
        plan = None
        fitted = n_tiles = 0
        stopped = False
        with stop_on_sigterm() as asked:
            for unit in packed.units(tiles):
                if asked.received:
                    stopped = True
                    break
                began = time.perf_counter()
                plan = plan or fitting.planned(design_axis, list(config.signal_terms))
                some = [(r.ty, r.tx) for r in tiles.where(F.col("unit") == unit).orderBy("ty", "tx").collect()]
                read = Observation()
                now = packed.read(unit, some).observe(read, F.count("*").alias("n_read"), F.sum(F.size("samples")).alias("n_samples"))
                fits = fitting.fit(now, plan, list(config.candidates), config.objective, config.max_iter, x0=x0, engine=engine, carry=("ty", "tx"))
                store.write_tiles(fits, some, config.criteria)
                n = store.series_in(some)
                store.record_commit(unit, len(some), n, read.get["n_read"], read.get["n_samples"] or 0, time.perf_counter() - began)
                fitted, n_tiles = fitted + n, n_tiles + len(some)
                if on_tiles_written:
                    on_tiles_written(some)
        return Report(n_series, fitted, attrs["fit_hash"], warnings, n_tiles, stopped, failure_rates(store, config))
    finally:
        packed.remove()


def failure_rates(store: Store, config: Config) -> dict[str, float]:
    """The share of eligible series that each candidate failed on, over the whole store."""
    if not store.exists("fits"):
        return {}
    o = F.col("outcome")
    rows = store.table("fits").groupBy("candidate").agg((F.count_if(is_failure(o)) / F.greatest(F.count_if(is_eligible(o)), F.lit(1))).alias("rate")).collect()
    return {r.candidate: r.rate for r in rows}
