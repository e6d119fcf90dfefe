"""Effective sample sizes from the model's correlations and the pattern of gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(on: np.ndarray) -> np.ndarray:
    """How many pairs of present places there are at each distance (..., n), from the transform of the pattern."""
    n = on.shape[-1]
    size = 1 << (2 * n - 1).bit_length()
    return np.rint(np.fft.irfft(np.abs(np.fft.rfft(on.astype(float), size)) ** 2, size)[..., :n])


def lag_pairs(samples: DataFrame) -> DataFrame:
    """(series_id, lag, pairs): present pairs at each index distance, the lag 0 included.

    The places of a series are packed, and its pairs counted from the transform of their pattern: memory is a few arrays as
    long as the series, whatever the number of pairs.
    """
    kind, key = samples.schema["i"].dataType.simpleString(), samples.schema["series_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = batch.column(1)[row].values.to_numpy()
                on = np.zeros(int(at.max() - at.min()) + 1)
                on[at - at.min()] = 1
                pairs = pair_counts(on).astype(np.int64)
                lag = np.flatnonzero(pairs)
                name = pa.repeat(batch.column(0)[row], len(lag))
                yield pa.RecordBatch.from_arrays([name, pa.array(lag).cast(batch.schema.field(1).type.value_type), pa.array(pairs[lag])], names=["series_id", "lag", "pairs"])

    packed = samples.where("i is not null").groupBy("series_id").agg(F.collect_set("i").alias("at"))
    return packed.mapInArrow(counted, f"series_id {key}, lag {kind}, pairs bigint")


def n_eff_regular(pairs: DataFrame, rho: Column) -> DataFrame:
    """(series_id, n, n_eff): n² over the sum of squared correlations; ``rho`` is over column ``lag``."""
    p = pairs.withColumn("both", F.when(F.col("lag") == 0, F.col("pairs")).otherwise(F.col("pairs") * 2))
    s = p.groupBy("series_id").agg(F.max(F.when(F.col("lag") == 0, F.col("pairs"))).alias("n"), F.sum(F.col("both") * rho * rho).alias("total"))
    return s.select("series_id", "n", (F.col("n") * F.col("n") / F.col("total")).alias("n_eff"))


def n_eff_irregular(packed: DataFrame, rho_sql: str) -> DataFrame:
    """The same for any spacing, over all pairs of times of a packed series; ``rho_sql`` is SQL over the lag ``d``."""
    total = f"aggregate(samples, 0D, (s, a) -> s + aggregate(samples, 0D, (r, b) -> r + get(transform(array(abs(a.t - b.t)), d -> power({rho_sql}, 2)), 0)))"
    p = packed.select("series_id", F.size("samples").cast("long").alias("n"), F.expr(total).alias("total"))
    return p.select("series_id", "n", (F.col("n") * F.col("n") / F.col("total")).alias("n_eff"))


def n_eff_closed_form(n: Column, rho_of: object) -> Column:
    """Complete regular series: n² / (n + 2 Σ (n-k) ρ_k²); ``rho_of`` maps a lag column to a correlation."""
    tail = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int") - 1, F.lit(1))), F.lit(0.0), lambda s, k: s + F.greatest(n - k, F.lit(0)) * F.pow(rho_of(k), 2))
    return n * n / (n + tail * 2.0)


def n_eff_trend(n: Column, var_white: Column, var_gls: Column) -> Column:
    """How many independent samples would estimate the trend as well, between 1 and n."""
    return F.least(F.greatest(F.try_divide(n * var_white, var_gls), F.lit(1.0)), n.cast("double"))
