"""Series that the queries work on, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# SQL of the same series, for the oracles.
SQL_S1 = "select cast(c_nationkey as bigint) as series_id, cast(date_trunc('month', o_orderdate) as timestamp) as ts, sum(o_totalprice) / 1e6::double as v from orders join customer on o_custkey = c_custkey group by 1, 2"
SQL_S2 = "select user_id as series_id, cast(date_trunc('day', ts) as timestamp) as ts, avg(value) as v from events group by 1, 2"
SQL_S3 = "select cast(ascii(event_type) as bigint) as series_id, cast(date_trunc('hour', ts) as timestamp) as ts, avg(value) as v from events group by 1, 2"
#: ``axis`` of the long table ``s``, and ``p``: present samples with place and time, centred trend and place in the series.
SQL_AXIS = """
years as (select distinct ts from s where ts is not null),
axis0 as (select ts, cast(year(ts) as double) + cast(epoch_us(ts) - epoch_us(make_timestamp(year(ts), 1, 1, 0, 0, 0)) as double)
  / cast(epoch_us(make_timestamp(year(ts) + 1, 1, 1, 0, 0, 0)) - epoch_us(make_timestamp(year(ts), 1, 1, 0, 0, 0)) as double) as t from years),
axis as (select cast(row_number() over (order by ts) - 1 as integer) as i, ts, t, t - lag(t) over (order by ts) as dt from axis0),
mid as (select avg(t) as mean_t, median(t - lag_t) as median_dt from (select t, lag(t) over (order by ts) as lag_t from axis0)),
p as (select series_id, i, t, t - mean_t as c, v, (v - avg(v) over (partition by series_id)) / stddev_pop(v) over (partition by series_id) as z, row_number() over (partition by series_id order by i) as rn, t - lag(t) over (partition by series_id order by i) as dt
  from s join axis using (ts) cross join mid where v is not null)
"""


def truncated(ts: str, unit: str) -> Column:
    """The start of a month, day or hour, without a time zone."""
    c, one, none = F.col(ts), F.lit(1), F.lit(0)
    return F.make_timestamp_ntz(F.year(c), F.month(c), one if unit == "month" else F.dayofmonth(c), F.hour(c) if unit == "hour" else none, none, none)


def long_nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover in millions per nation and month."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return rows.groupBy(F.col("c_nationkey").cast("long").alias("series_id"), truncated("o_orderdate", "month").alias("ts")).agg((F.sum("o_totalprice") / 1e6).alias("v"))


def long_user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per user and day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.col("user_id").alias("series_id"), truncated("ts", "day").alias("ts")).agg(F.avg("value").alias("v"))


def long_type_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per event type (known by its first letter's code) and hour."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.ascii("event_type").cast("long").alias("series_id"), truncated("ts", "hour").alias("ts")).agg(F.avg("value").alias("v"))


LONG = {"nation_month": (long_nation_month, SQL_S1), "user_day": (long_user_day, SQL_S2), "type_hour": (long_type_hour, SQL_S3)}
