"""Readers for long tables of samples, by declared scheme or suffix, and the checks before a run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.timeaxis import GREGORIAN, CalendarError, calendar_of, timestamp_of
from tidewright.operators.series import axis, calendar_in, contract, distinct_steps
from tidewright.plans.config import digest


class InputError(ValueError):
    """An input that is not a table of samples over time."""


def _spark_format(name: str, **options: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, uri: spark.read.format(name).options(**options).load(uri)


#: Openers by scheme or suffix; the kind of an input is declared, never sniffed.
OPENERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": _spark_format("parquet"),
    "orc": _spark_format("orc"),
    "json": _spark_format("json"),
    "csv": _spark_format("csv", header="true", inferSchema="true"),
}


def register(scheme: str, opener: Callable[[SparkSession, str], DataFrame]) -> None:
    if scheme in OPENERS:
        raise InputError(f"an opener for {scheme!r} is registered already")
    OPENERS[scheme] = opener


def scheme_of(uri: str) -> str:
    """The scheme before a ``+`` or ``:`` if an opener has it, else the suffix."""
    scheme = urlparse(uri).scheme.partition("+")[0]
    if scheme in OPENERS:
        return scheme
    suffix = uri.rstrip("/").rpartition("/")[2].rpartition(".")[2]
    if suffix in OPENERS:
        return suffix
    raise InputError(f"no opener for {uri!r}; known: {', '.join(sorted(OPENERS))}")


def open_raw(spark: SparkSession, uri: str) -> DataFrame:
    """What the opener of a URI gives; its errors name the URI."""
    scheme = scheme_of(uri)
    try:
        return OPENERS[scheme](spark, uri[len(scheme) + 1 :].removeprefix("//") if urlparse(uri).scheme == scheme else uri)
    except InputError:
        raise
    except Exception as e:
        raise InputError(f"{uri} could not be opened as {scheme}: {str(e).splitlines()[0] if str(e) else type(e).__name__}") from e


def source_units(df: DataFrame, column: str) -> str | None:
    """The units that a column's metadata state, first what it is encoded in, then what it is."""
    metadata = df.schema[column].metadata or {}
    return metadata.get("encoding_units") or metadata.get("units")


DATE = ("year", "month", "day")


def open_long(spark: SparkSession, uri: str, variable: str) -> DataFrame:
    """(series_id, y, x, ts, v) from a table with ``ts``, the variable, and ``y``/``x`` or ``series_id``.

    In place of ``ts`` there may be integers ``year``, ``month`` and ``day``, in the calendar that the metadata of ``year`` name;
    a date that the calendar has not is a sample without a time.  The metadata of ``ts`` name the calendar.
    """
    raw = open_raw(spark, uri)
    types = dict(raw.dtypes)
    calendar = GREGORIAN
    if "ts" not in types and set(DATE) <= set(types):
        if odd := [c for c in DATE if types[c] not in ("tinyint", "smallint", "int", "bigint")]:
            raise InputError(f"{odd[0]} is {types[odd[0]]}; dates are given in integers")
        try:
            calendar = calendar_of((raw.schema["year"].metadata or {}).get("calendar", GREGORIAN))
        except CalendarError as e:
            raise InputError(str(e)) from None
        raw = raw.withColumn("ts", timestamp_of(*(F.col(c).cast("int") for c in DATE), calendar))
        types = dict(raw.dtypes)
    if variable not in types or "ts" not in types:
        raise InputError(f"{uri} has no column {variable!r} or no column 'ts'; it has {', '.join(raw.columns)}")
    if not types["ts"].startswith("timestamp") and types["ts"] != "date":
        raise InputError(f"the time column is {types['ts']}; numbers have no calendar")
    if {"y", "x"} <= set(types):
        place = [F.col("y").cast("int"), F.col("x").cast("int")]
        key = F.col("series_id").cast("long") if "series_id" in types else F.col("y").cast("long") * (1 << 31) + F.col("x")
    elif "series_id" in types:
        key, place = F.col("series_id").cast("long"), [F.col("series_id").cast("int").alias("y"), F.lit(0).alias("x")]
    else:
        raise InputError(f"{uri} has neither y and x nor series_id")
    return raw.select(key.alias("series_id"), *place, F.col("ts").cast("timestamp_ntz").alias("ts", metadata={"calendar": calendar}), F.col(variable).cast("double").alias("v"))


def duplicates(long: DataFrame) -> DataFrame:
    """(series_id, ts, n) of the times that a series has more than once; a table has no order, so nothing else can run backwards."""
    return long.groupBy("series_id", "ts").agg(F.count("*").alias("n")).where("n > 1")


def check_times(long: DataFrame) -> None:
    """Refuses samples without a time and series with two samples at one time."""
    if not long.where("ts is null").isEmpty():
        raise InputError("there are samples without a time")
    if found := duplicates(long).limit(1).collect():
        raise InputError(f"series {found[0].series_id} has {found[0].n} samples at {found[0].ts}; times of a series increase")


def checked(long: DataFrame) -> dict:
    """The contract's figures, refused if there is no time axis of at least two steps or a series has a time twice."""
    row = contract(long).first().asDict()
    if row["n_time"] < 2 or row["n_bad_steps"]:
        raise InputError(f"the time axis has {row['n_time']} times and {row['n_bad_steps']} steps that do not increase")
    check_times(long)
    return row


@dataclass(frozen=True)
class ContractReport:
    """What an input is, before anything is fitted."""

    n_time: int
    n_series: int
    n_present: int
    t_start: float
    t_end: float
    median_dt: float
    unique_dt: tuple[float, ...]
    calendar: str
    dtype: str
    units: str | None


def report(spark: SparkSession, uri: str, variable: str) -> ContractReport:
    raw, long = open_raw(spark, uri), open_long(spark, uri, variable)
    facts = checked(long)
    steps = tuple(r.rep for r in distinct_steps(axis(long)).orderBy("rep").collect())
    return ContractReport(**{k: facts[k] for k in ("n_time", "n_series", "n_present", "t_start", "t_end", "median_dt")}, unique_dt=steps, calendar=calendar_in(long), dtype=dict(raw.dtypes)[variable], units=source_units(raw, variable))


#: The parts of a geometry in the order in which a difference is reported.
COMPONENTS = ("variable", "calendar", "n_series", "places", "n_time", "first", "last", "times")


def geometry(long: DataFrame, variable: str) -> dict:
    """Shape, axis and places of the series; values do not enter."""
    return geometry_of(long.select("series_id", "y", "x").distinct(), long.select("ts").distinct(), variable, calendar_in(long))


def geometry_of(places: DataFrame, times: DataFrame, variable: str, calendar: str = GREGORIAN) -> dict:
    """The same from tables that are distinct already."""
    p = places.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("series_id", "y", "x"), F.lit(1 << 40))).alias("places")).first()
    t = times.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum(F.pmod(F.xxhash64("ts"), F.lit(1 << 40))).alias("times")).first()
    return {"variable": variable, "n_series": p.n, "places": p.places, "n_time": t.n, "first": str(t["first"]), "last": str(t["last"]), "times": t.times, "calendar": calendar}


def geometry_hash(long: DataFrame, variable: str) -> str:
    return digest(geometry(long, variable))


def describe_mismatch(stored: dict, requested: dict) -> str | None:
    """Which component differs first, in words; None if none does."""
    for c in COMPONENTS:
        if stored.get(c) != requested.get(c):
            if c in ("places", "times"):
                return f"the {c} of the series differ from those that the store was written with, though there are as many"
            return f"{c} differs: the store was written with {stored.get(c)!r}, and this input has {requested.get(c)!r}"
    return None
