"""From long samples to packed series on a shared axis.

Long form: (series_id, ts, v), one row per present sample.  NaN and infinite values are gaps, as NULL is.
Packed form: (series_id, samples), samples an array of (i, t, v) in order of i; gaps are absent, which the filters treat
exactly as a skipped update.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.timeaxis import GREGORIAN, calendar_of, decimal_year, new_step
from tidewright.operators.lineage import kept


def present(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def calendar_in(df: DataFrame) -> str:
    """The calendar that the metadata of ``ts`` name."""
    return calendar_of((df.schema["ts"].metadata or {}).get("calendar", GREGORIAN))


def axis(long: DataFrame) -> DataFrame:
    """(i, ts, t, dt) of the distinct times of all series: as long as the axis, not as the data."""
    return axis_of(long.select("ts").where("ts is not null").distinct(), calendar_in(long))


def axis_of(times: DataFrame, calendar: str = GREGORIAN) -> DataFrame:
    """The same from the distinct times.

    Times are numbered month by month: each month is a group of its own, and only its count and last time, a row a month,
    are summed up on the driver.  So no task sees the whole axis, and the data is scanned once for it.
    """
    times = kept(times.select("ts").withColumn("month", F.year("ts") * 12 + F.month("ts")))
    months, base, before = times.groupBy("month").agg(F.count("*").alias("n"), F.max("ts").alias("last")).collect(), 0, None
    rows = []
    for m in sorted(months, key=lambda m: m.month):
        rows.append((m.month, base, before))
        base, before = base + m.n, m.last
    earlier = times.sparkSession.createDataFrame(rows, "month int, base long, before timestamp_ntz")
    own = Window.partitionBy("month").orderBy("ts")
    placed = times.join(F.broadcast(earlier), "month")
    placed = placed.select((F.col("base") + F.row_number().over(own) - 1).cast("int").alias("i"), "ts", F.coalesce(F.lag("ts").over(own), "before").alias("before"))
    t = decimal_year(F.col("ts"), calendar)
    return placed.select("i", "ts", t.alias("t"), (t - decimal_year(F.col("before"), calendar)).alias("dt"))


def axis_mean(axis: DataFrame) -> DataFrame:
    """One row with the mean time of the whole axis, by which trends are centred."""
    return axis.agg(F.avg("t").alias("mean_t"))


def contract(long: DataFrame) -> DataFrame:
    """One row: n_time, n_series, n_present, t_start, t_end, median_dt, n_bad_steps (steps that do not increase)."""
    a = axis(long).agg(
        F.count("*").alias("n_time"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.median("dt").alias("median_dt"), F.count_if(F.col("dt") <= 0).alias("n_bad_steps")
    )
    s = long.agg(F.countDistinct("series_id").alias("n_series"), F.count_if(present(F.col("v"))).alias("n_present"))
    both = a.unionByName(s, allowMissingColumns=True)  # one row each, put side by side
    return both.agg(*(F.max(c).alias(c) for c in (*a.columns, *s.columns)))


def indexed(long: DataFrame, axis: DataFrame) -> DataFrame:
    """Present samples with their place and time on the axis."""
    return long.where(present(F.col("v"))).join(axis.select("ts", "i", "t"), "ts").select("series_id", "i", "t", F.col("v").cast("double").alias("v"))


def pack(samples: DataFrame, *extra: str) -> DataFrame:
    """One row per series; the only shuffle of the way from long samples to fits."""
    return samples.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("i", "t", "v", *extra))).alias("samples"))


def distinct_steps(axis: DataFrame) -> DataFrame:
    """(rep, n_steps): the distinct steps of an axis up to the relative tolerance; the representative is the smallest."""
    order = Window.orderBy("dt")
    steps = axis.where("dt is not null").groupBy("dt").agg(F.count("*").alias("n"))
    flagged = steps.withColumn("opens", new_step(F.col("dt"), F.lag("dt").over(order)).cast("int"))
    cluster = flagged.withColumn("cluster", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cluster.groupBy("cluster").agg(F.min("dt").alias("rep"), F.sum("n").alias("n_steps")).drop("cluster")


def representative(axis: DataFrame, steps: DataFrame) -> DataFrame:
    """Every step with the last representative that is not above it (an as-of lookup in a small sorted array)."""
    reps = steps.agg(F.array_sort(F.collect_list("rep")).alias("reps"))
    below = F.filter("reps", lambda r: r <= F.col("dt"))
    return axis.where("dt is not null").join(F.broadcast(reps)).select("i", "dt", F.element_at(below, -1).alias("rep"))


def moments(samples: DataFrame, median_dt: DataFrame) -> DataFrame:
    """Starting values: (series_id, n, var, r1, sigma0, rho0, rung) from variance and lag-one correlation by index.

    The lag is one place on the axis, so a pair with a gap counts zero; without a correlation between 0 and 1 the time
    scale is the default, and without a variance both are.
    """
    by_index = Window.partitionBy("series_id").orderBy("i")
    c = samples.withColumn("c", F.col("v") - F.avg("v").over(Window.partitionBy("series_id")))
    c = c.withColumn("before", F.when(F.lag("i").over(by_index) == F.col("i") - 1, F.lag("c").over(by_index)))
    m = c.groupBy("series_id").agg(F.count("*").alias("n"), F.var_pop("v").alias("var"), F.try_divide(F.sum(F.coalesce(F.col("c") * F.col("before"), F.lit(0.0))), F.sum(F.col("c") * F.col("c"))).alias("r1"))
    m = m.crossJoin(F.broadcast(median_dt))
    some, related = (F.col("n") > 1) & (F.col("var") > 0), (F.col("r1") > 0) & (F.col("r1") < 1)
    sigma, rho = F.sqrt("var"), F.when(related, -F.col("median_dt") / F.log("r1"))
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    sigma0, rho0 = clip(F.when(some, sigma).otherwise(1.0), 1e-8, 1e8), clip(F.when(some & related, rho).otherwise(1.0), 1e-6, 1e6)
    clipped = some & ((sigma != sigma0) | (related & (rho != rho0)))
    rung = F.when(~some | ~F.coalesce(related, F.lit(False)), "DEFAULT").when(clipped, "CLIPPED").otherwise("MOMENT")
    return m.select("series_id", "n", "var", "r1", sigma0.alias("sigma0"), rho0.alias("rho0"), rung.alias("rung"))
