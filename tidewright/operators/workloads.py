"""Workloads to time and to judge fits by: patterns of gaps, series drawn from a candidate, and what their fits took."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.families import FAMILIES, Layout
from tidewright.functions.outcomes import is_ok

# The patterns of gaps, the models by the size of their state, and the rows drawn for each state dimension.
GAP_CASES = ("none", "scattered_10", "contiguous_40")
MODELS = {1: "white + matern12", 3: "white + matern12 + matern32"}
ROWS_PER_DIMENSION = 4


def model(dim: int) -> str:
    if dim not in MODELS:
        raise ValueError(f"there are models for state sizes {sorted(MODELS)}, not {dim}")
    return MODELS[dim]


def true_parameters(dim: int) -> np.ndarray:
    """Natural parameters of every term: scales that do not hide each other."""
    values = {"matern12": [0.5, 1.0], "matern32": [0.8, 0.25], "white": [0.4]}
    return np.array([v for kind in Layout.of(model(dim)).kinds for v in values[kind]])


def gap_present(case: str, series: Column, i: Column, n_time: int, seed: int = 11) -> Column:
    """Whether a sample is there; the same for a series, place and seed on any partitioning."""
    if case == "none":
        return F.lit(True)
    if case == "scattered_10":
        return F.pmod(F.xxhash64(series, i, F.lit(seed)), F.lit(1_000_000)) >= 100_000
    if case == "contiguous_40":
        width = int(0.4 * n_time)
        start = F.pmod(F.xxhash64(series, F.lit(seed)), F.lit(n_time - width))
        return ~((i >= start) & (i < start + width))
    raise ValueError(f"unknown pattern of gaps {case!r}; known: {', '.join(GAP_CASES)}")


def drawn(spark: SparkSession, dim: int, n_time: int, rows: int | None = None, seed: int = 3) -> DataFrame:
    """(series_id, samples): monthly series drawn from a model's own covariance, each from its own seed."""
    layout, theta, t = Layout.of(model(dim)), true_parameters(dim), np.arange(n_time) / 12.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lag, cov, at = t[:, None] - t[None, :], np.zeros((n_time, n_time)), 0
        for kind in layout.kinds:
            f = FAMILIES[kind]
            cov += f.covariance(lag, *theta[at : at + len(f.params)])
            at += len(f.params)
        root = np.linalg.cholesky(cov)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [[{"i": i, "t": float(t[i]), "v": float(x)} for i, x in enumerate(root @ np.random.default_rng([seed, s]).normal(size=n_time))] for s in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("i", pa.int32()), ("t", pa.float64()), ("v", pa.float64())])))], names=["series_id", "samples"])

    ids = spark.range(rows or ROWS_PER_DIMENSION * dim).select(F.col("id").alias("series_id"))
    return ids.mapInArrow(run, "series_id bigint, samples array<struct<i:int,t:double,v:double>>")


def with_gaps(packed: DataFrame, case: str, n_time: int, seed: int = 11) -> DataFrame:
    return packed.withColumn("samples", F.filter("samples", lambda s: gap_present(case, F.col("series_id"), s["i"], n_time, seed)))


def iteration_statistics(fits: DataFrame) -> DataFrame:
    """(candidate, mean_iterations, max_iterations, utilization, n_ok, n_sample) over the fits that came out OK."""
    ok = is_ok(F.col("outcome"))
    its = F.when(ok, F.col("iterations"))
    out = fits.groupBy("candidate").agg(F.avg(its).alias("mean_iterations"), F.max(its).alias("max_iterations"), F.count_if(ok).alias("n_ok"), F.count("*").alias("n_sample"))
    return out.select("candidate", "mean_iterations", "max_iterations", F.try_divide("mean_iterations", "max_iterations").alias("utilization"), "n_ok", "n_sample")
