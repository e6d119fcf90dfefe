"""Tables about the candidates: their parameters, ragged offsets, covariance slots, capabilities and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.families import FAMILIES, Layout, gradient_mode, labels

#: Which engines can score a family, and at what cost class (the sum of terms costs its dearest).
ENGINES = {"white": {"kalman": 0}, "matern12": {"kalman": 1}, "matern32": {"kalman": 1}}


class IncompatibleSpecError(ValueError):
    """A candidate that no engine can score."""


def parameter_table(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """(m, model, place, term, kind, name): a row per free parameter, in the order of the parameter vector."""
    rows = []
    for m, text in enumerate(candidates):
        layout = Layout.of(text)
        names = labels(layout.kinds)
        kind_of = dict(zip(names, layout.kinds, strict=True))
        flat = [(term, kind_of[term], name) for term, name in layout.free_names]
        rows += [(m, " + ".join(names), i, *x) for i, x in enumerate(flat)]
    return spark.createDataFrame(rows, "m int, model string, place int, term string, kind string, name string")


def free_index(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """(m, term, name, place, is_free, free_place, value): all parameters, where the free ones are, and the fixed values."""
    rows = []
    for m, text in enumerate(candidates):
        layout = Layout.of(text)
        at = {i: k for k, i in enumerate(layout.free)}
        rows += [(m, term, name, i, i in at, at.get(i), layout.fixed[i]) for i, (term, name) in enumerate(layout.names)]
    return spark.createDataFrame(rows, "m int, term string, name string, place int, is_free boolean, free_place int, value double")


def hydrated(fits: DataFrame, index: DataFrame) -> DataFrame:
    """(series_id, m, theta): all natural parameters, from the free ones of ``fits`` (series_id, m, theta) and the fixed values."""
    slots = index.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("place", "free_place", "value"))).alias("slots"))
    whole = F.transform("slots", lambda s: F.coalesce(s["value"], F.get("theta", s["free_place"])))
    return fits.select("series_id", "m", "theta").join(slots, "m").select("series_id", "m", F.when(F.col("theta").isNotNull(), whole).alias("theta"))


def block(values: Column, offset: Column, extent: Column) -> Column:
    """What belongs to one candidate in a ragged array."""
    return F.slice(values, offset.cast("int") + 1, extent.cast("int"))


def gradient_modes(spark: SparkSession, candidates: list[str], objective: str) -> DataFrame:
    """(m, mode): whether all terms of a candidate have derivatives for the objective; an empty claim is refused."""
    return spark.createDataFrame([(m, gradient_mode(c, objective)) for m, c in enumerate(candidates)], "m int, mode string")


def ragged_index(parameters: DataFrame) -> DataFrame:
    """(m, extent, offset, cov_extent, cov_offset): where each candidate's parameters and packed covariance begin."""
    before = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parameters.groupBy("m").agg(F.count("*").alias("extent")).withColumn("cov_extent", (F.col("extent") * (F.col("extent") + 1) / 2).cast("long"))
    running = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c.replace('extent', '')}offset")
    return sizes.select("m", "extent", running("extent"), "cov_extent", running("cov_extent"))


def covariance_slots(p: Column) -> Column:
    """The (i, j) of a packed lower triangle, row by row; empty for no parameters."""
    last = p.cast("int") - 1
    rows = F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(F.lit(0), i), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    return F.when(last >= 0, F.flatten(rows)).otherwise(F.array().cast("array<struct<i:int,j:int>>"))


def covariance_entries(fits: DataFrame, column: str) -> DataFrame:
    """(series_id, m, i, j, value) of the lower triangles that a column of packed covariances holds; none where it is NULL."""
    size = F.floor((F.sqrt(F.size(column) * 8 + 1) - 1) / 2)
    slots = F.zip_with(covariance_slots(size), F.col(column), lambda s, v: F.struct(s["i"].alias("i"), s["j"].alias("j"), v.alias("value")))
    return fits.where(F.col(column).isNotNull()).select("series_id", "m", F.inline(slots))


def correlations_of(entries: DataFrame) -> DataFrame:
    """(series_id, m, i, j, correlation) below the diagonal, from covariance entries."""
    diagonal = entries.where("i = j").select("series_id", "m", "i", "value")
    side = lambda c: diagonal.select("series_id", "m", F.col("i").alias(c), F.col("value").alias(f"var_{c}"))
    rows = entries.where("i > j").join(side("i"), ["series_id", "m", "i"]).join(side("j"), ["series_id", "m", "j"])
    return rows.select("series_id", "m", "i", "j", F.try_divide(F.col("value"), F.sqrt(F.col("var_i") * F.col("var_j"))).alias("correlation"))


def capabilities(parameters: DataFrame, engines: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(m, engine, cost): the engines that every term of a candidate has, at the greatest of its costs."""
    table = engines or ENGINES
    rows = [(kind, engine, cost) for kind, costs in table.items() for engine, cost in costs.items()]
    costs = parameters.sparkSession.createDataFrame(rows, "kind string, engine string, cost int")
    terms = parameters.select("m", "term", "kind").distinct()
    every = terms.groupBy("m").agg(F.count("*").alias("terms"))
    got = terms.join(costs, "kind").groupBy("m", "engine").agg(F.count("*").alias("able"), F.max("cost").alias("cost"))
    return got.join(every, "m").where("able = terms").select("m", "engine", "cost")


def check_capable(parameters: DataFrame, engine: str) -> DataFrame:
    """The parameters, refused if a candidate has a term that the engine cannot score."""
    able = capabilities(parameters).where(F.col("engine") == engine)
    left = parameters.join(able, "m", "left_anti").select("model").distinct().limit(1).collect()
    if left:
        raise IncompatibleSpecError(f"{engine} cannot score {left[0].model}")
    return parameters


def resume_differences(stored: DataFrame, requested: DataFrame) -> DataFrame:
    """(m, stored, requested) of the places at which two lists of candidate hashes (m, hash) differ."""
    both = stored.select("m", F.col("hash").alias("stored")).join(requested.select("m", F.col("hash").alias("requested")), "m", "full_outer")
    return both.where(~F.col("stored").eqNullSafe(F.col("requested")))
