"""Registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions.criteria import CRITERIA, penalty
from tidewright.functions.design import design
from tidewright.functions.families import LIMITS, acvf
from tidewright.functions.timeaxis import YEARS, calendar_of, decimal_year, timestamp_of
from tidewright.operators import counting, fitting, gls, grid, models, selection
from tidewright.operators import series as ops
from tidewright.operators.linear import line_report
from tidewright.operators.filtering import LOG_2PI, augmented, matern32_loglik, ou_loglik, white_loglik
from tidewright.plans.data import LONG, SQL_AXIS, truncated
from tidewright.sources.store import scores_of as scores_of_fits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def union_sql(template: str, names: tuple[str, ...] = tuple(LONG)) -> str:
    """One SELECT over several series sets; ``{s}`` stands for the set's long table, ``{name}`` for its name."""
    return " union all ".join("select * from (" + template.format(s=LONG[n][1], name=n) + ")" for n in names)


def each(spark: SparkSession, sf_dir: str, f: Callable[[DataFrame], DataFrame], names: tuple[str, ...] = tuple(LONG)) -> DataFrame:
    out = None
    for n in names:
        part = f(LONG[n][0](spark, sf_dir)).withColumn("series_set", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


# ---- time axes -------------------------------------------------------------------------------------------------------


@query(union_sql("with s as ({s}), " + SQL_AXIS + " select '{name}' as series_set, ts, round(t, 9) as t from axis"))
def q01_decimal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir, lambda s: ops.axis(s).select("ts", r("t", 9).alias("t")))


@query(union_sql("with s as ({s}), " + SQL_AXIS + """ select '{name}' as series_set, (select count(*) from axis) as n_time, round(min(axis.t), 9) as t_start, round(max(axis.t), 9) as t_end, round(median(dt), 9) as median_dt,
  count(*) filter (dt <= 0) as n_bad_steps, (select count(distinct series_id) from s) as n_series, (select count(v) from s) as n_present from axis"""))
def q02_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir, lambda s: ops.contract(s).select("n_time", r("t_start", 9).alias("t_start"), r("t_end", 9).alias("t_end"), r("median_dt", 9).alias("median_dt"), "n_bad_steps", "n_series", "n_present"))


SQL_STEPS = """
d as (select dt, count(*) as n from axis where dt is not null group by dt),
g as (select *, case when lag(dt) over (order by dt) is null or dt - lag(dt) over (order by dt) > 1e-9::double * greatest(abs(dt), abs(lag(dt) over (order by dt))) then 1 else 0 end as opens from d),
k as (select *, sum(opens) over (order by dt) as cluster from g),
steps as (select min(dt) as rep, cast(sum(n) as bigint) as n_steps from k group by cluster)"""


@query(union_sql("with s as ({s}), " + SQL_AXIS + "," + SQL_STEPS + " select '{name}' as series_set, round(rep, 9) as rep, n_steps from steps"))
def q03_unique_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir, lambda s: ops.distinct_steps(ops.axis(s)).select(r("rep", 9).alias("rep"), "n_steps"))


@query(union_sql("with s as ({s}), " + SQL_AXIS + " select '{name}' as series_set, series_id, count(*) as n_present, (select count(*) from axis) - count(*) as n_gaps, min(i) as first_i, max(i) as last_i from p group by series_id"))
def q04_presence_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(s: DataFrame) -> DataFrame:
        a = ops.axis(s)
        out = ops.indexed(s, a).groupBy("series_id").agg(F.count("*").alias("n_present"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))
        return out.crossJoin(F.broadcast(a.agg(F.count("*").alias("n")))).withColumn("n_gaps", F.col("n") - F.col("n_present")).drop("n")

    return each(spark, sf_dir, f)


@query(union_sql("with s as ({s}), " + SQL_AXIS + " select '{name}' as series_set, series_id, count(*) as n, round(arg_min(v, i), 6) as first_v, round(arg_max(v, i), 6) as last_v, round(sum((i + 1) * v), 4) as weighted from p group by series_id"))
def q05_pack_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(s: DataFrame) -> DataFrame:
        p = ops.pack(ops.indexed(s, ops.axis(s)))
        total = F.aggregate("samples", F.lit(0.0), lambda a, e: a + (e["i"] + 1) * e["v"])
        return p.select("series_id", F.size("samples").cast("long").alias("n"), r(F.element_at("samples", 1)["v"]).alias("first_v"), r(F.element_at("samples", -1)["v"]).alias("last_v"), r(total, 4).alias("weighted"))

    return each(spark, sf_dir, f)


TERMS = ["constant", "trend", "accel", "annual", "semiannual", "harmonic:0.25", "offset:1998.5", "rate_change:1998.5"]
NAMES = ["constant", "trend", "accel", "annual_cos", "annual_sin", "semi_cos", "semi_sin", "quarter_cos", "quarter_sin", "offset", "rate_change"]


@query("with s as (" + LONG["nation_month"][1] + "), " + SQL_AXIS + """ select ts, 1.0::double as constant, round(t - mean_t, 6) as trend, round((t - mean_t) * (t - mean_t) / 2, 6) as accel,
  round(cos(2 * pi() * t), 6) as annual_cos, round(sin(2 * pi() * t), 6) as annual_sin, round(cos(4 * pi() * t), 6) as semi_cos, round(sin(4 * pi() * t), 6) as semi_sin,
  round(cos(8 * pi() * t), 6) as quarter_cos, round(sin(8 * pi() * t), 6) as quarter_sin, case when t >= 1998.5 then 1.0::double else 0.0::double end as offset, round(greatest(t - 1998.5::double, 0), 6) as rate_change from axis cross join mid""")
def q06_design_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ops.axis(LONG["nation_month"][0](spark, sf_dir))
    x = a.crossJoin(F.broadcast(ops.axis_mean(a)))
    return x.select("ts", *(r(c).alias(n) for c, n in zip(design(TERMS, F.col("t"), F.col("mean_t")), NAMES, strict=True)))


# ---- samples in the form that the filters take ------------------------------------------------------------------------


def samples_of(name: str, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(axis, samples) with standardised values z and centred times c."""
    s = LONG[name][0](spark, sf_dir)
    a = ops.axis(s)
    series = Window.partitionBy("series_id")
    p = ops.indexed(s, a).crossJoin(F.broadcast(ops.axis_mean(a))).withColumn("c", F.col("t") - F.col("mean_t"))
    return a, p.withColumn("z", F.try_divide(F.col("v") - F.avg("v").over(series), F.stddev_pop("v").over(series))).drop("mean_t")


def standard(p: DataFrame) -> DataFrame:
    """Packed with z as the value."""
    return ops.pack(p.where("z is not null").select("series_id", "i", "t", F.col("z").alias("v"), "c"), "c")


def filter_sql(grid_sql: str, name: str, value: str = "z") -> str:
    """A recursive filter of a Matérn-1/2 process plus white noise, one run per series and row of the grid (m, sigma, rho, tau)."""
    return f"""with recursive s as ({LONG[name][1]}), {SQL_AXIS},
g as ({grid_sql}),
f as (
  select series_id, m, sigma, rho, tau, rn, sigma * sigma / (sigma * sigma + tau * tau) * {value} as x, sigma * sigma - sigma * sigma / (sigma * sigma + tau * tau) * sigma * sigma as pp,
    {value} * {value} / (sigma * sigma + tau * tau) as q, ln(sigma * sigma + tau * tau) as l, 1 as n
  from p cross join g where rn = 1
  union all
  select series_id, m, sigma, rho, tau, rn, xm + pm / (pm + tau * tau) * (y - xm), pm - pm / (pm + tau * tau) * pm, q + (y - xm) * (y - xm) / (pm + tau * tau), l + ln(pm + tau * tau), n + 1
  from (select p.series_id, f.m, sigma, rho, tau, p.rn, {value} as y, exp(-p.dt / rho) * x as xm, exp(-2 * p.dt / rho) * pp + sigma * sigma * (1 - exp(-2 * p.dt / rho)) as pm, q, l, n
    from f join p on p.series_id = f.series_id and p.rn = f.rn + 1)),
ll as (select series_id, m, sigma, rho, tau, n, -0.5 * (n * ln(2 * pi()) + l + q) as loglik from f qualify rn = max(rn) over (partition by series_id, m))
"""


def theta_grid(sigmas: list[float], rhos: list[float], taus: list[float]) -> list[tuple[int, float, float, float]]:
    return [(i, *x) for i, x in enumerate((s, p, t) for s in sigmas for p in rhos for t in taus)]


def grid_sql(rows: list[tuple[int, float, float, float]]) -> str:
    return "select * from (values " + ", ".join(f"({m}, {s}::double, {p}::double, {t}::double)" for m, s, p, t in rows) + ") as t(m, sigma, rho, tau)"


def over_grid(packed: DataFrame, rows: list[tuple[int, float, float, float]]) -> DataFrame:
    """Every series with every row of the grid: the grid is a literal, so nothing is shuffled."""
    points = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(s).alias("sigma"), F.lit(p).alias("rho"), F.lit(t).alias("tau")) for m, s, p, t in rows))
    return packed.withColumn("g", F.explode(points)).select("*", "g.*").drop("g")


GAUSS = "-0.5 * (count(*) * (ln(2 * pi()) + 2 * ln({tau})) + sum(z * z) / ({tau} * {tau}))"


@query("with s as (" + LONG["nation_month"][1] + "), " + SQL_AXIS + " select series_id, count(*) as n, round(" + GAUSS.format(tau="0.9::double") + ", 5) as loglik from p group by series_id")
def q09_white_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = samples_of("nation_month", spark, sf_dir)
    return standard(p).withColumn("r", white_loglik("samples", "0.9D")).select("series_id", "r.n", r("r.loglik", 5).alias("loglik"))


ONE_OU, ONE_BOTH, ONE_DAY = [(0, 1.0, 0.5, 0.0)], [(0, 0.8, 0.5, 0.6)], [(0, 0.8, 0.01, 0.6)]


def filtered(name: str, rows: list[tuple[int, float, float, float]], spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = samples_of(name, spark, sf_dir)
    return over_grid(standard(p), rows).withColumn("r", ou_loglik("samples", "sigma", "rho", "tau"))


@query(filter_sql(grid_sql(ONE_OU), "nation_month") + "select series_id, cast(n as bigint) as n, round(loglik, 5) as loglik from ll")
def q10_ou_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered("nation_month", ONE_OU, spark, sf_dir).select("series_id", "r.n", r("r.loglik", 5).alias("loglik"))


@query("select 'nation_month' as series_set, * from (" + filter_sql(grid_sql(ONE_BOTH), "nation_month") + "select series_id, cast(n as bigint) as n, round(loglik, 5) as loglik from ll) union all select 'user_day', * from ("
       + filter_sql(grid_sql(ONE_DAY), "user_day") + "select series_id, cast(n as bigint) as n, round(loglik, 5) as loglik from ll)")
def q11_ou_white_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [filtered(n, g, spark, sf_dir).select(F.lit(n).alias("series_set"), "series_id", "r.n", r("r.loglik", 5).alias("loglik")) for n, g in (("nation_month", ONE_BOTH), ("user_day", ONE_DAY))]
    return parts[0].unionByName(parts[1])


@query(filter_sql(grid_sql(ONE_DAY), "user_day") + "select series_id, cast(n as bigint) as n, round(loglik, 5) as masked, round(loglik, 5) as absent from ll")
def q12_masked_equals_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps as NULL samples on the whole axis, and gaps as absent samples."""
    a, p = samples_of("user_day", spark, sf_dir)
    packed = standard(p)
    times = a.agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("axis"))
    full = packed.crossJoin(F.broadcast(times)).withColumn("by_i", F.map_from_entries(F.transform("samples", lambda e: F.struct(e["i"], e["v"]))))
    full = full.withColumn("whole", F.transform("axis", lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"), F.try_element_at("by_i", x["i"]).alias("v"))))
    _, s, rho, tau = ONE_DAY[0]
    both = full.select("series_id", ou_loglik("whole", f"{s}D", f"{rho}D", f"{tau}D").alias("a"), ou_loglik("samples", f"{s}D", f"{rho}D", f"{tau}D").alias("b"))
    return both.select("series_id", F.col("a.n").alias("n"), r("a.loglik", 5).alias("masked"), r("b.loglik", 5).alias("absent"))


# ---- design and least squares -----------------------------------------------------------------------------------------


@query("with s as (" + LONG["nation_month"][1] + "), " + SQL_AXIS + """ select series_id, count(*) as n, round(sum(c), 5) as s_c, round(sum(c * c), 5) as s_cc, round(sum(cos(2 * pi() * t)), 5) as s_cos, round(sum(c * sin(2 * pi() * t)), 5) as s_csin,
  round(sum(v), 5) as s_y, round(sum(c * v), 5) as s_cy from p group by series_id""")
def q07_gram_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = samples_of("nation_month", spark, sf_dir)
    angle = F.col("t") * 2 * F.pi()
    sums = {"s_c": F.col("c"), "s_cc": F.col("c") * F.col("c"), "s_cos": F.cos(angle), "s_csin": F.col("c") * F.sin(angle), "s_y": F.col("v"), "s_cy": F.col("c") * F.col("v")}
    return p.groupBy("series_id").agg(F.count("*").alias("n"), *(r(F.sum(c), 5).alias(n) for n, c in sums.items()))


SQL_WHITE = """w as (select series_id, count(*) as n, avg(z) as z0, regr_slope(z, c) as b1, regr_intercept(z, c) as b0, sum(z * z) - count(*) * avg(z) * avg(z) as rss0, regr_syy(z, c) - regr_sxy(z, c) * regr_sxy(z, c) / regr_sxx(z, c) as rss1 from p group by series_id)"""


def white_fits(p: DataFrame) -> DataFrame:
    """Constant, and constant plus trend, under white noise of fitted variance: one aggregation."""
    sxy, sxx = F.regr_sxy("z", "c"), F.regr_sxx("z", "c")
    return p.where("z is not null").groupBy("series_id").agg(
        F.count("*").alias("n"), F.regr_slope("z", "c").alias("b1"), F.regr_intercept("z", "c").alias("b0"), F.regr_syy("z", "c").alias("rss0"), (F.regr_syy("z", "c") - sxy * sxy / sxx).alias("rss1")
    )


def white_ml(rss: str) -> Column:
    return -(F.col("n") * (LOG_2PI + 1 + F.log(F.col(rss) / F.col("n")))) / 2


@query("with s as (" + LONG["nation_month"][1] + "), " + SQL_AXIS + ", " + SQL_WHITE + """ select series_id, n, round(b0, 6) as b0, round(b1, 6) as b1, round(sqrt(rss1 / n), 6) as sigma,
  round(-0.5 * n * (ln(2 * pi()) + 1 + ln(rss1 / n)), 5) as loglik from w""")
def q08_ols_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = samples_of("nation_month", spark, sf_dir)
    return white_fits(p).select("series_id", "n", r("b0").alias("b0"), r("b1").alias("b1"), r(F.sqrt(F.col("rss1") / F.col("n"))).alias("sigma"), r(white_ml("rss1"), 5).alias("loglik"))


SIGMA, RHO, TAU = 0.8, 0.5, 0.6


def aug_sql(tail: str) -> str:
    """The augmented filter on [z, 1, c] as a recursion; ``tail`` selects from ``d`` with the products."""
    pairs = [("y", "y"), ("y", "o"), ("y", "c"), ("o", "o"), ("o", "c"), ("c", "c")]
    names = [f"a_{i}{j}" for i, j in pairs]
    value = {"y": "z", "o": "1.0::double", "c": "c"}
    s0 = f"({SIGMA * SIGMA + TAU * TAU!r}::double)"
    p0 = f"({SIGMA * SIGMA!r}::double)"
    first = ", ".join(f"({value[i]}) * ({value[j]}) / {s0} as {n}" for (i, j), n in zip(pairs, names, strict=True))
    later = ", ".join(f"{n} + d{i} * d{j} / (pm + {TAU * TAU!r}::double)" for (i, j), n in zip(pairs, names, strict=True))
    return f"""with recursive s as ({LONG["nation_month"][1]}), {SQL_AXIS},
f as (
  select series_id, rn, {p0} / {s0} * z as xy, {p0} / {s0} as xo, {p0} / {s0} * c as xc, {p0} - {p0} / {s0} * {p0} as pp, {first}, ln({s0}) as l, 1 as n from p where rn = 1
  union all
  select series_id, rn, my + pm / (pm + {TAU * TAU!r}::double) * dy, mo + pm / (pm + {TAU * TAU!r}::double) * "do", mc + pm / (pm + {TAU * TAU!r}::double) * dc, pm - pm / (pm + {TAU * TAU!r}::double) * pm, {later.replace("do ", '"do" ').replace("do/", '"do"/')}, l + ln(pm + {TAU * TAU!r}::double), n + 1
  from (select *, z - my as dy, 1 - mo as "do", c - mc as dc from (select p.series_id, p.rn, z, c, exp(-p.dt / {RHO}) * xy as my, exp(-p.dt / {RHO}) * xo as mo, exp(-p.dt / {RHO}) * xc as mc,
    exp(-2 * p.dt / {RHO}) * pp + {p0} * (1 - exp(-2 * p.dt / {RHO})) as pm, {", ".join(names)}, l, n from f join p on p.series_id = f.series_id and p.rn = f.rn + 1))),
d as (select *, a_oo * a_cc - a_oc * a_oc as det from f qualify rn = max(rn) over (partition by series_id)),
b as (select *, (a_cc * a_yo - a_oc * a_yc) / det as b0, (a_oo * a_yc - a_oc * a_yo) / det as b1 from d),
e as (select *, -0.5 * (n * ln(2 * pi()) + l + a_yy - b0 * a_yo - b1 * a_yc) as ml from b)
{tail}"""


def normal_equations(p: DataFrame) -> DataFrame:
    """n, logdet and the whitened products of [z, 1, c] of every series."""
    packed = standard(p).withColumn("r", augmented("samples", ["1D", "e.c"], f"{SIGMA}D", f"{RHO}D", f"{TAU}D"))
    at = lambda i, j: F.get("r.a", F.lit(3 * i + j))
    return packed.select("series_id", "samples", "r.n", "r.logdet", at(0, 0).alias("y0"), at(0, 1).alias("y1"), at(0, 2).alias("y2"), at(1, 1).alias("g11"), at(1, 2).alias("g12"), at(2, 2).alias("g22"))


@query(aug_sql("select series_id, cast(n as bigint) as n, round(l, 5) as logdet, round(a_yy, 5) as y0, round(a_yo, 5) as y1, round(a_yc, 5) as y2, round(a_oo, 5) as g11, round(a_oc, 5) as g12, round(a_cc, 5) as g22 from d"))
def q13_augmented_normal_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = samples_of("nation_month", spark, sf_dir)
    return normal_equations(p).select("series_id", "n", *(r(c, 5).alias(c) for c in ("logdet", "y0", "y1", "y2", "g11", "g12", "g22")))


@query(aug_sql("select series_id, cast(n as bigint) as n, round(b0, 6) as b0, round(b1, 6) as b1, round(sqrt(a_oo / det), 6) as b1_err, round(ml, 5) as loglik, case when det > 0 then 0 else 6 end as outcome from e"))
def q14_gls_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = samples_of("nation_month", spark, sf_dir)
    return gls.solve_two(normal_equations(p)).select("series_id", "n", r("b0").alias("b0"), r("b1").alias("b1"), r(F.sqrt("c11")).alias("b1_err"), r("loglik", 5).alias("loglik"), "outcome")


def with_plain_gram(df: DataFrame) -> DataFrame:
    """Adds the unweighted Gram of [1, c]."""
    fold = lambda f: F.aggregate("samples", F.lit(0.0), lambda a, e: a + f(e))
    return df.withColumn("h11", F.col("n").cast("double")).withColumn("h12", fold(lambda e: e["c"])).withColumn("h22", fold(lambda e: e["c"] * e["c"]))


@query(aug_sql(", h as (select series_id, count(*) as h11, sum(c) as h12, sum(c * c) as h22 from p group by series_id) select e.series_id, round(ml + ln(2 * pi()) + 0.5 * ln(h11 * h22 - h12 * h12) - 0.5 * ln(det), 5) as reml from e join h using (series_id)"))
def q15_reml(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = samples_of("nation_month", spark, sf_dir)
    return gls.restricted(with_plain_gram(gls.solve_two(normal_equations(p)))).select("series_id", r("reml", 5).alias("reml"))


M32 = """with recursive s as ({s}), {axis},
k as (select sqrt(3.0::double) / 0.4::double as lam),
f as (
  select series_id, rn, 0.64::double / 1.0::double * z as x, 0.0::double as y, 0.64::double - 0.64::double * 0.64::double as pp, 0.0::double as cc, 0.64::double * lam * lam as rr, z * z as q, 0.0::double as l, 1 as n from p cross join k where rn = 1
  union all
  select series_id, rn, mx + mp / (mp + 0.36) * (z - mx), my + mc / (mp + 0.36) * (z - mx), mp - mp / (mp + 0.36) * mp, mc - mp / (mp + 0.36) * mc, mr - mc / (mp + 0.36) * mc, q + (z - mx) * (z - mx) / (mp + 0.36), l + ln(mp + 0.36), n + 1
  from (select *, fa * x + fb * y as mx, fc * x + fd * y as my, fa * fa * pp + 2 * fa * fb * cc + fb * fb * rr + 0.64::double * (1 - exp(-u) * (1 + u + u * u / 2)) as mp,
      fa * fc * pp + (fa * fd + fb * fc) * cc + fb * fd * rr + 0.64::double * 2 * lam * lam * lam * dt * dt * exp(-u) as mc, fc * fc * pp + 2 * fc * fd * cc + fd * fd * rr + 0.64::double * lam * lam * (1 - exp(-u) * (1 - u + u * u / 2)) as mr
    from (select p.series_id, p.rn, z, p.dt, lam, 2 * lam * p.dt as u, x, y, pp, cc, rr, q, l, n, exp(-lam * p.dt) * (1 + lam * p.dt) as fa, exp(-lam * p.dt) * p.dt as fb, -exp(-lam * p.dt) * lam * lam * p.dt as fc, exp(-lam * p.dt) * (1 - lam * p.dt) as fd
      from f join p on p.series_id = f.series_id and p.rn = f.rn + 1 cross join k)))
select series_id, cast(n as bigint) as n, round(-0.5 * (n * ln(2 * pi()) + l + q), 5) as loglik from f qualify rn = max(rn) over (partition by series_id)"""


@query(M32.format(s=LONG["nation_month"][1], axis=SQL_AXIS))
def q16_matern32_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = samples_of("nation_month", spark, sf_dir)
    return standard(p).withColumn("r", matern32_loglik("samples", "0.8D", "0.4D", "0.6D")).select("series_id", "r.n", r("r.loglik", 5).alias("loglik"))


# ---- selection --------------------------------------------------------------------------------------------------------

GRID = theta_grid([0.5, 1.0], [0.1, 0.5, 2.0], [0.3, 0.8])


@query(filter_sql(grid_sql(GRID), "nation_month") + "select series_id, arg_max(m, (loglik, -m)) as best_m, round(max(loglik), 5) as loglik, count(*) as n_grid from ll group by series_id")
def q32_theta_grid_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = filtered("nation_month", GRID, spark, sf_dir).select("series_id", "m", "r.loglik")
    top = F.max(F.struct("loglik", (-F.col("m")).alias("m")))
    return scored.groupBy("series_id").agg(top.alias("top"), F.count("*").alias("n_grid")).select("series_id", (-F.col("top.m")).alias("best_m"), r("top.loglik", 5).alias("loglik"), "n_grid")


# Three candidates: 0 white with a constant, 1 white with constant and trend, 2 the best of the grid of OU + white.
SQL_SCORES = filter_sql(grid_sql(GRID), "nation_month") + ", " + SQL_WHITE + """,
o as (select series_id, max(loglik) as loglik, max(n) as n from ll group by series_id),
raw as (
  select series_id, 0 as m, -0.5 * n * (ln(2 * pi()) + 1 + ln(rss0 / n)) as loglik, 1 as p, 1 as rank, n from w
  union all select series_id, 1, -0.5 * n * (ln(2 * pi()) + 1 + ln(rss1 / n)), 1, 2, n from w
  union all select series_id, 2, loglik, 3, 0, n from o),
scores as (select series_id, m, loglik, cast(p + rank as double) as k, cast(n as double) as n, cast(n as double) / (1 + m) as n_eff, 0 as outcome from raw),
crit as (select unnest(['aic', 'aicc', 'bic', 'bic_neff', 'hqic']) as criterion),
ic as (select series_id, m, outcome, criterion, case when outcome <> 0 then null
    when criterion = 'aic' then -2 * loglik + 2 * k
    when criterion = 'aicc' then case when n - k - 1 > 0 then -2 * loglik + 2 * k + 2 * k * (k + 1) / (n - k - 1) else 'infinity'::double end
    when criterion = 'bic' then case when n > 1 then -2 * loglik + k * ln(n) end
    when criterion = 'bic_neff' then case when n_eff > 1 then -2 * loglik + k * ln(n_eff) end
    else case when n > exp(1) then -2 * loglik + 2 * k * ln(ln(n)) end end as ic from scores cross join crit),
ranked as (select *, min(case when isfinite(ic) then ic end) over w as ic_best, coalesce(arg_min(m, (ic, m)) filter (isfinite(ic)) over w, -1) as selected, count(*) filter (outcome = 0) over w as n_valid,
    case when isfinite(ic) then exp(-0.5 * (ic - min(case when isfinite(ic) then ic end) over w)) else 0 end as raw_weight from ic window w as (partition by series_id, criterion)),
final as (select *, ic - ic_best as delta_ic, coalesce(raw_weight / nullif(sum(raw_weight) over (partition by series_id, criterion), 0), 0) as weight from ranked)
"""


def scores_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the three candidates in the form that the selection takes."""
    _, p = samples_of("nation_month", spark, sf_dir)
    w = white_fits(p)
    white = w.select("series_id", F.inline(F.array(*(F.struct(F.lit(m).alias("m"), white_ml(f"rss{m}").alias("loglik"), F.lit(1).alias("p"), F.lit(m + 1).alias("rank")) for m in (0, 1)))), "n")
    ou = over_grid(standard(p), GRID).withColumn("r", ou_loglik("samples", "sigma", "rho", "tau")).groupBy("series_id").agg(F.max("r.loglik").alias("loglik"), F.max("r.n").alias("n"))
    raw = white.unionByName(ou.select("series_id", F.lit(2).alias("m"), "loglik", F.lit(3).alias("p"), F.lit(0).alias("rank"), "n"))
    k, n = penalty("ml", F.col("p"), F.col("rank"), F.col("n"))
    return raw.select("series_id", "m", "loglik", k.alias("k"), n.alias("n"), (n / (F.col("m") + 1)).alias("n_eff"), F.lit(0).alias("outcome"), F.lit("kalman").alias("engine"), F.lit("ml").alias("objective"))


@query(aug_sql(", h as (select 'ml' as objective, 3 + 2 as k, 0 as used union all select 'reml', 3, 2) select series_id, objective, cast(k as double) as k, cast(n - used as double) as n from e cross join h"))
def q17_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = samples_of("nation_month", spark, sf_dir)
    g = gls.solve_two(normal_equations(p)).where("outcome = 0").select("series_id", F.col("n").alias("n_obs"))
    rows = [F.struct(F.lit(o).alias("objective"), *(c.alias(x) for c, x in zip(penalty(o, F.lit(3), F.lit(2), F.col("n_obs")), ("k", "n"), strict=True))) for o in ("ml", "reml")]
    return g.select("series_id", F.inline(F.array(*rows)))


@query(SQL_SCORES + "select series_id, m, criterion, round(ic, 5) as ic from final")
def q18_ic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ic_values(scores_of(spark, sf_dir), CRITERIA).select("series_id", "m", "criterion", r("ic", 5).alias("ic"))


RANKED = "select series_id, m, criterion, round(delta_ic, 5) as delta_ic, round(weight, 5) as weight, round(ic_best, 5) as ic_best, selected, n_valid from final"


def shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("series_id", "m", "criterion", r("delta_ic", 5).alias("delta_ic"), r("weight", 5).alias("weight"), r("ic_best", 5).alias("ic_best"), "selected", "n_valid")


@query(SQL_SCORES + RANKED)
def q19_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(selection.rank(scores_of(spark, sf_dir), CRITERIA))


# Outcomes that follow from the data: a candidate of a series whose number and place add up to a multiple of 3 failed.
FAIL = "case when (series_id + m) % 3 = 0 then cast(1 + (series_id * 7 + m) % 13 as integer) else 0 end"
SQL_FAILED = SQL_SCORES.replace("cast(n as double) / (1 + m) as n_eff, 0 as outcome from raw", f"cast(n as double) / (1 + m) as n_eff, {FAIL} as outcome from raw")


def failed(scores: DataFrame) -> DataFrame:
    code = F.when((F.col("series_id") + F.col("m")) % 3 == 0, (1 + (F.col("series_id") * 7 + F.col("m")) % 13).cast("int")).otherwise(0)
    out = scores.withColumn("outcome", code)
    return out.withColumns({c: F.when(F.col("outcome") == 0, F.col(c)) for c in ("loglik", "k", "n", "n_eff")})


@query(SQL_FAILED + RANKED)
def q20_rank_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(selection.rank(failed(scores_of(spark, sf_dir)), CRITERIA))


@query(SQL_FAILED + """select series_id, count(*) filter (outcome = 0) as n_valid, case when bool_or(outcome = 0) then 0 else
  arg_min(outcome, (case outcome when 10 then 0 when 8 then 1 when 6 then 2 when 11 then 3 when 5 then 4 else 5 end, outcome)) end as point_outcome from scores group by series_id""")
def q21_point_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.points(failed(scores_of(spark, sf_dir)))


@query(SQL_FAILED + """select m, count(*) filter (outcome not in (10, 13)) as n_eligible, count(*) filter (outcome not in (0, 8, 10, 12, 13)) as n_failed,
  round(count(*) filter (outcome not in (0, 8, 10, 12, 13)) / count(*) filter (outcome not in (10, 13))::double, 6) as failure_rate from scores group by m""")
def q22_failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.failure_rates(failed(scores_of(spark, sf_dir))).withColumn("failure_rate", r("failure_rate"))


@query("with s as (" + LONG["nation_month"][1] + ") select distinct series_id, cast(2 as bigint) as n_engines, cast(1 as bigint) as n_objectives from s where series_id % 5 = 0")
def q23_comparability_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every fifth series are marked as from another engine for one candidate."""
    other = F.when((F.col("series_id") % 5 == 0) & (F.col("m") == 1), "compiled").otherwise(F.col("engine"))
    return selection.mixed(scores_of(spark, sf_dir).withColumn("engine", other))


@query(SQL_SCORES + "select distinct series_id, criterion, round(ic_best, 5) as ic_best, selected, n_valid from final")
def q33_grid_model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = selection.best(selection.rank(selection.check_comparable(scores_of(spark, sf_dir)), CRITERIA))
    return best.withColumn("ic_best", r("ic_best", 5))


@query(SQL_FAILED + "select count(*) as n_rows, cast(0 as bigint) as n_value_not_ok, cast(0 as bigint) as n_ok_without_value, cast(0 as bigint) as n_negative_infinity from scores")
def q45_status_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.violations(failed(scores_of(spark, sf_dir)), ("loglik", "k", "n", "n_eff"))


@query(SQL_FAILED + RANKED.replace("from final", "from final where criterion in ('bic', 'hqic')"))
def q46_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(selection.recompute(failed(scores_of(spark, sf_dir)), ("bic", "hqic")))


# ---- effective sample sizes -------------------------------------------------------------------------------------------


@query("with s as (" + LONG["user_day"][1] + "), " + SQL_AXIS + " select a.series_id, b.i - a.i as lag, count(*) as pairs from p a join p b on a.series_id = b.series_id and b.i >= a.i group by 1, 2")
def q24_lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.lag_pairs(samples_of("user_day", spark, sf_dir)[1])


@query("with s as (" + LONG["user_day"][1] + "), " + SQL_AXIS + ", q as (select a.series_id, b.i - a.i as lag, count(*) as pairs from p a join p b on a.series_id = b.series_id and b.i >= a.i group by 1, 2)"
       + " select series_id, cast(max(case when lag = 0 then pairs end) as bigint) as n, round(max(case when lag = 0 then pairs end) * max(case when lag = 0 then pairs end) / sum(case when lag = 0 then pairs else 2 * pairs * exp(-lag / 3.0::double) * exp(-lag / 3.0::double) * 0.4096::double end), 5) as n_eff from q group by series_id")
def q25_neff_bic_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OU process of 3 days with white noise: correlation 0.64 exp(-lag/3), 1 at lag 0."""
    lag = F.col("lag").cast("double")
    kinds, theta = ("matern12", "white"), [0.8, 3.0, 0.6]
    rho = acvf(kinds, theta, lag) / acvf(kinds, theta, F.lit(0.0))
    pairs = counting.lag_pairs(samples_of("user_day", spark, sf_dir)[1])
    return counting.n_eff_regular(pairs, rho).select("series_id", "n", r("n_eff", 5).alias("n_eff"))


@query("with s as (" + LONG["nation_month"][1] + "), " + SQL_AXIS + " select a.series_id, cast(sqrt(count(*)) as bigint) as n, round(count(*) / sum(case when a.i = b.i then 1 else power(0.64::double * exp(-abs(a.t - b.t) / 0.5::double), 2) end), 5) as n_eff from p a join p b on a.series_id = b.series_id group by 1")
def q26_neff_bic_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = ops.pack(samples_of("nation_month", spark, sf_dir)[1].select("series_id", "i", "t", "v"))
    return counting.n_eff_irregular(packed, "if(d = 0, 1D, 0.64D * exp(-d / 0.5D))").select("series_id", "n", r("n_eff", 5).alias("n_eff"))


@query("with s as (" + LONG["user_day"][1] + "), " + SQL_AXIS + ", c as (select series_id, count(*) as n from p group by series_id), k as (select series_id, n, unnest(range(1, cast(n as bigint))) as k from c)"
       + " select series_id, n, round(n * n / (n + 2 * sum((n - k) * exp(-2 * k / 3.0::double))), 5) as n_eff from k group by series_id, n")
def q27_neff_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each series would be worth without gaps."""
    n = samples_of("user_day", spark, sf_dir)[1].groupBy("series_id").agg(F.count("*").alias("n"))
    return n.select("series_id", "n", r(counting.n_eff_closed_form(F.col("n"), lambda k: F.exp(k * -1.0 / 3.0)), 5).alias("n_eff"))


@query(aug_sql(", h as (select series_id, count(*) as h11, sum(c) as h12, sum(c * c) as h22 from p group by series_id) select e.series_id, round(least(greatest(n * (h11 / (h11 * h22 - h12 * h12)) / (a_oo / det), 1), n), 5) as n_eff_trend from e join h using (series_id)"))
def q28_neff_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The process has variance 0.64 + 0.36 = 1, so the trend's variance under white noise is the plain inverse Gram's."""
    _, p = samples_of("nation_month", spark, sf_dir)
    g = with_plain_gram(gls.solve_two(normal_equations(p)))
    white = F.col("h11") / (F.col("h11") * F.col("h22") - F.col("h12") * F.col("h12"))
    return g.select("series_id", r(counting.n_eff_trend(F.col("n"), white, F.col("c11")), 5).alias("n_eff_trend"))


SQL_MOMENTS = """, cm as (select series_id, i, v - avg(v) over (partition by series_id) as c from p),
lg as (select *, case when lag(i) over (partition by series_id order by i) = i - 1 then c * lag(c) over (partition by series_id order by i) else 0 end as cc from cm),
mo as (select series_id, count(*) as n, sum(c * c) / count(*) as var, sum(cc) / nullif(sum(c * c), 0) as r1 from lg group by series_id),
st as (select series_id, n, var, r1, sqrt(var) as s, case when r1 > 0 and r1 < 1 then -median_dt / ln(case when r1 > 0 and r1 < 1 then r1 else 0.5 end) end as rho from mo cross join mid)"""


def moments_of(s: DataFrame) -> DataFrame:
    a = ops.axis(s)
    return ops.moments(ops.indexed(s, a), a.agg(F.median("dt").alias("median_dt")))


@query(union_sql("with s as ({s}), " + SQL_AXIS + SQL_MOMENTS + """ select '{name}' as series_set, series_id, n, round(var, 6) as var, round(r1, 6) as r1, round(greatest(least(s, 1e8), 1e-8), 6) as sigma0, round(case when rho is null then 1 else greatest(least(rho, 1e6), 1e-6) end, 6) as rho0,
  case when rho is null then 'DEFAULT' else 'MOMENT' end as rung from st""", ("nation_month", "user_day")))
def q29_moment_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, sf_dir, lambda s: moments_of(s).select("series_id", "n", r("var").alias("var"), r("r1").alias("r1"), r("sigma0").alias("sigma0"), r("rho0").alias("rho0"), "rung"), ("nation_month", "user_day"))


@query("with s as (" + LONG["user_day"][1] + "), " + SQL_AXIS + SQL_MOMENTS + " select series_id, s <= 1e-8 or s >= 1e8 as sigma_at_limit, coalesce(rho, 1) <= 1e-6 or coalesce(rho, 1) >= 1e6 as rho_at_limit from st")
def q30_diag_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda c, x: (F.col(c) <= LIMITS[x][0]) | (F.col(c) >= LIMITS[x][1])
    return moments_of(LONG["user_day"][0](spark, sf_dir)).select("series_id", at("sigma0", "sigma").alias("sigma_at_limit"), at("rho0", "rho").alias("rho_at_limit"))


@query(union_sql("with s as ({s}), " + SQL_AXIS + "," + SQL_STEPS + ", dts as (select i, dt from axis where dt is not null) select '{name}' as series_set, i, round(dt, 9) as dt, round(rep, 9) as rep from dts asof join steps on dts.dt >= steps.rep", ("nation_month", "type_hour")))
def q31_step_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(s: DataFrame) -> DataFrame:
        a = ops.axis(s)
        return ops.representative(a, ops.distinct_steps(a)).select("i", r("dt", 9).alias("dt"), r("rep", 9).alias("rep"))

    return each(spark, sf_dir, f, ("nation_month", "type_hour"))


# ---- tiles, completion, resumption ------------------------------------------------------------------------------------

SQL_GRID = "with c as (select distinct user_id as series_id from events), pts as (select series_id, cast(series_id // 40 as bigint) as y, cast(series_id % 40 as bigint) as x from c)"


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users laid out on a grid of 40 columns."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("series_id")).distinct()
    return users.select("series_id", F.floor(F.col("series_id") / 40).alias("y"), (F.col("series_id") % 40).alias("x"))


@query(SQL_GRID + " select y // 16 as ty, x // 16 as tx, count(*) as n_series, min(y) as first_y, max(x) as last_x from pts group by 1, 2")
def q34_tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tiled(points_of(spark, sf_dir), 16).groupBy("ty", "tx").agg(F.count("*").alias("n_series"), F.min("y").alias("first_y"), F.max("x").alias("last_x"))


SQL_SPANS = SQL_GRID + """, e as (select max(y) + 1 as ny, max(x) + 1 as nx from pts), a as (select 'y' as axis, ny as n from e union all select 'x', nx from e),
t as (select axis, n, k as tile, k * 16 as t0, least((k + 1) * 16, n) as t1 from a, unnest(range(0, cast(ceil(n / 16.0) as bigint))) as u(k)),
ch as (select axis, k as chunk, k * 10 as c0, least((k + 1) * 10, n) as c1 from a, unnest(range(0, cast(ceil(n / 10.0) as bigint))) as u(k)),
sp as (select t.axis, tile, chunk, greatest(t0, c0) as start, least(t1, c1) as stop, c1 - c0 as chunk_points from t join ch on t.axis = ch.axis and t0 < c1 and c0 < t1)"""


@query(SQL_SPANS + ' select axis, tile, chunk, start, stop as "end", chunk_points from sp')
def q35_chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.spans(points_of(spark, sf_dir), 16, 10)


@query(SQL_SPANS + """, r as (select axis, tile, sum(chunk_points) as read, sum(stop - start) as used from sp group by 1, 2)
select a.tile as ty, b.tile as tx, cast(a.read * b.read as bigint) as points_read, cast(a.used * b.used as bigint) as points_used, round(a.read * b.read / (a.used * b.used)::double, 6) as amplification from r a join r b on a.axis = 'y' and b.axis = 'x'""")
def q36_read_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.read_amplification(grid.spans(points_of(spark, sf_dir), 16, 10)).withColumn("amplification", r("amplification"))


DONE = "(ty + tx) % 2 = 1"


@query(SQL_GRID + f", t as (select distinct y // 16 as ty, x // 16 as tx from pts) select ty, tx from t where not ({DONE})")
def q37_completion_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = grid.tiled(points_of(spark, sf_dir), 16).select("ty", "tx").distinct()
    return grid.outstanding(tiles, tiles.where(DONE))


# ---- fits -------------------------------------------------------------------------------------------------------------


@query()
def q48_full_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of three candidates to every nation's series; a value is checked against a dense likelihood in the tests."""
    s = LONG["nation_month"][0](spark, sf_dir)
    a = ops.axis(s)
    packed = ops.pack(ops.indexed(s, a))
    return fitting.fit(packed, fitting.planned(a, ["constant", "trend", "annual"]), ["white", "matern12", "white + matern12"])


@query()
def q51_fit_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of every user's series, ranked under all criteria."""
    s = LONG["user_day"][0](spark, sf_dir)
    a = ops.axis(s)
    fits = fitting.fit(ops.pack(ops.indexed(s, a)), fitting.planned(a, ["constant"]), ["white", "white + matern12"])
    return selection.rank(scores_of_fits(fits), CRITERIA)


@query("with s as (" + LONG["nation_month"][1] + "), " + SQL_AXIS + " select series_id, round(stddev_pop(v), 6) as sigma, round(stddev_pop(v) / sqrt(2 * count(*)), 6) as sigma_err from p group by series_id")
def q50_delta_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White noise in closed form: the Hessian in ln(sigma) is 2n, and the delta method brings the error back to sigma."""
    _, p = samples_of("nation_month", spark, sf_dir)
    m = p.groupBy("series_id").agg(F.stddev_pop("v").alias("sigma"), F.count("*").alias("n"))
    variance = F.try_divide(F.lit(1.0), F.col("n") * 2)
    return m.select("series_id", r("sigma").alias("sigma"), r(F.sqrt(variance * F.col("sigma") * F.col("sigma"))).alias("sigma_err"))


@query("with s as (" + LONG["nation_month"][1] + "), " + SQL_AXIS + """, f as (select series_id, count(*) as n, regr_slope(v, i) as slope, regr_intercept(v, i) as intercept, sqrt((regr_syy(v, i) - regr_slope(v, i) * regr_sxy(v, i)) / (count(*) - 2)) as residual_sd, regr_sxx(v, i) as sxx, avg(i) as mean_i from p group by series_id)
select series_id, any_value(n) as n, round(any_value(slope), 8) as slope, round(any_value(intercept), 6) as intercept, round(any_value(residual_sd), 6) as residual_sd, round(any_value(residual_sd / sqrt(sxx)), 8) as slope_err,
  round(avg(case when i > mean_i then v - intercept - slope * i end) - avg(case when i <= mean_i then v - intercept - slope * i end), 6) as half_difference from p join f using (series_id) group by series_id""")
def q49_line_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p = samples_of("nation_month", spark, sf_dir)
    digits = {"slope": 8, "intercept": 6, "residual_sd": 6, "slope_err": 8, "half_difference": 6}
    return line_report(p, "series_id", "i", "v").select("series_id", "n", *(r(c, d).alias(c) for c, d in digits.items()))


# ---- the whole way of a fit, where SQL can follow it ------------------------------------------------------------------


def standard_packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(axis, packed series of standardised turnover)."""
    a, p = samples_of("nation_month", spark, sf_dir)
    return a, ops.pack(p.where("z is not null").select("series_id", "i", "t", F.col("z").alias("v")))


@query("with s as (" + LONG["nation_month"][1] + "), " + SQL_AXIS + ", " + SQL_WHITE + """ select series_id, cast(n as double) as n, 3.0::double as k, 0 as outcome, round(-0.5 * n * (ln(2 * pi()) + 1 + ln(rss1 / n)), 3) as loglik, round(b0, 5) + 0.0::double as b0, round(b1, 5) + 0.0::double as b1,
  round(cast(n as double), 6) as n_eff from w""")
def q52_white_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White noise with constant and trend, fitted as any candidate is; least squares give the same in closed form."""
    a, packed = standard_packed(spark, sf_dir)
    fits = fitting.fit(packed, fitting.planned(a, ["constant", "trend"]), ["white"])
    return fits.select("series_id", "n", "k", "outcome", r("loglik", 3).alias("loglik"), (r(F.col("beta")[0], 5) + 0.0).alias("b0"), (r(F.col("beta")[1], 5) + 0.0).alias("b1"), r("n_eff_bic").alias("n_eff"))


@query(aug_sql(""", h as (select series_id, count(*) as h11, sum(c) as h12, sum(c * c) as h22 from p group by series_id),
two as (select series_id, 'ml' as objective, cast(n as double) as n, 2.0::double as k, ml as loglik, b0, b1, sqrt(a_oo / det) as b1_err from e
  union all select series_id, 'reml', cast(n as double) - 2, 0.0::double, ml + ln(2 * pi()) + 0.5 * ln(h11 * h22 - h12 * h12) - 0.5 * ln(det), b0, b1, sqrt(a_oo / det) from e join h using (series_id))
select series_id, objective, n, k, 0 as outcome, round(loglik, 5) as loglik, round(b0, 6) + 0.0::double as b0, round(b1, 6) + 0.0::double as b1, round(b1_err, 6) as b1_err from two"""))
def q53_fixed_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate whose parameters are all fixed, under both objectives: filter, profile, errors and counts of the fit."""
    a, packed = standard_packed(spark, sf_dir)
    plan, model = fitting.planned(a, ["constant", "trend"]), f"white(sigma={TAU}) + matern12(sigma={SIGMA}, rho={RHO})"
    fits = fitting.fit(packed, plan, [model], "ml").unionByName(fitting.fit(packed, plan, [model], "reml"))
    return fits.select("series_id", "objective", "n", "k", "outcome", r("loglik", 5).alias("loglik"), (r(F.col("beta")[0]) + 0.0).alias("b0"), (r(F.col("beta")[1]) + 0.0).alias("b1"), r(F.col("beta_err")[1]).alias("b1_err"))


@query(SQL_SCORES.split("crit as (")[0].rstrip().rstrip(",") + """, broken as (select series_id, m, k, n, n_eff, case when series_id % 3 = 1 and m = 1 then null when series_id % 4 = 0 and m = 2 then '-infinity'::double else loglik end as loglik,
  case when series_id % 3 = 0 and m = 0 then 3 else outcome end as outcome from scores)
select count(*) as n_rows, count(*) filter (outcome <> 0 and (loglik is not null or k is not null or n is not null or n_eff is not null)) as n_value_not_ok,
  count(*) filter (outcome = 0 and (loglik is null or k is null or n is null or n_eff is null)) as n_ok_without_value, count(*) filter (loglik = '-infinity'::double) as n_negative_infinity from broken""")
def q54_broken_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status invariant on scores that break it in each of the three ways."""
    s, m = F.col("series_id"), F.col("m")
    loglik = F.when((s % 3 == 1) & (m == 1), None).when((s % 4 == 0) & (m == 2), float("-inf")).otherwise(F.col("loglik"))
    broken = scores_of(spark, sf_dir).withColumn("loglik", loglik).withColumn("outcome", F.when((s % 3 == 0) & (m == 0), 3).otherwise(F.col("outcome")))
    return selection.violations(broken, ("loglik", "k", "n", "n_eff"))


@query(SQL_SCORES.split("crit as (")[0].rstrip().rstrip(",") + """, marked as (select series_id, case when series_id % 4 = 0 and m = 1 then 'dense' when series_id % 8 = 0 and m = 2 then 'other' else 'kalman' end as engine,
  case when series_id % 6 = 0 and m = 0 then 'reml' else 'ml' end as objective from scores)
select series_id, count(distinct engine) as n_engines, count(distinct objective) as n_objectives from marked group by series_id having count(distinct engine) > 1 or count(distinct objective) > 1""")
def q55_mixed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from up to three engines and two objectives, counted by series."""
    s, m = F.col("series_id"), F.col("m")
    engine = F.when((s % 4 == 0) & (m == 1), "dense").when((s % 8 == 0) & (m == 2), "other").otherwise("kalman")
    marked = scores_of(spark, sf_dir).withColumn("engine", engine).withColumn("objective", F.when((s % 6 == 0) & (m == 0), "reml").otherwise("ml"))
    return selection.mixed(marked)


# ---- covariances, correlated fits, regressors of each series, calendars and covers -------------------------------------


@query(aug_sql("""select series_id, i, j, round(case when i = 1 and j = 1 then a_oo when i = 0 then a_cc else -a_oc end / det, 8) + 0.0::double as value, 0 as outcome
from b cross join (values (0, 0), (1, 0), (1, 1)) as t(i, j)"""))
def q56_fit_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed covariance of two coefficients under a correlated model, entry by entry."""
    a, packed = standard_packed(spark, sf_dir)
    fits = fitting.fit(packed, fitting.planned(a, ["constant", "trend"]), [f"white(sigma={TAU}) + matern12(sigma={SIGMA}, rho={RHO})"])
    entries = models.covariance_entries(fits, "beta_cov").join(fits.select("series_id", "outcome"), "series_id")
    return entries.select("series_id", "i", "j", (r("value", 8) + 0.0).alias("value"), "outcome")


@query("with s as (" + LONG["nation_month"][1] + "), " + SQL_AXIS + """ select series_id, count(*) as n, round(stddev_pop(z), 4) as sigma, round(stddev_pop(z) / sqrt(2 * count(*)), 4) as sigma_err, round(var_pop(z) / (2 * count(*)), 5) as sigma_var from p group by series_id""")
def q57_white_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a fitted parameter, from the curvature of the likelihood; for white noise it is 2n in ln(sigma)."""
    a, packed = standard_packed(spark, sf_dir)
    fits = fitting.fit(packed, fitting.planned(a, ["constant"]), ["white"])
    return fits.select("series_id", F.col("n").cast("long").alias("n"), r(F.col("theta")[0], 4).alias("sigma"), r(F.col("theta_err")[0], 4).alias("sigma_err"), r(F.col("theta_cov")[0], 5).alias("sigma_var"))


FIXED_SIGMA, FIXED_RHO = 0.3, 0.5


def search_sql(rounds: int = 5) -> str:
    """The white part of a correlated model with a constant, by a grid that is refined around its best, and its error by a second difference."""
    p0 = f"{FIXED_SIGMA * FIXED_SIGMA!r}::double"

    def filtered_over(grid: str, out: str) -> str:
        return f"""{out} as (
  select p.series_id, k, tau, rn, {p0} / ({p0} + tau * tau) * z as xy, {p0} / ({p0} + tau * tau) as xo, {p0} - {p0} / ({p0} + tau * tau) * {p0} as pp,
    z * z / ({p0} + tau * tau) as yy, z / ({p0} + tau * tau) as yo, 1 / ({p0} + tau * tau) as oo, ln({p0} + tau * tau) as l, 1 as n from p join {grid} g on g.series_id = p.series_id where rn = 1
  union all
  select series_id, k, tau, rn, my + pm / s * (z - my), mo + pm / s * (1 - mo), pm - pm / s * pm, yy + (z - my) * (z - my) / s, yo + (z - my) * (1 - mo) / s, oo + (1 - mo) * (1 - mo) / s, l + ln(s), n + 1
  from (select *, pm + tau * tau as s from (select p.series_id, f.k, f.tau, p.rn, z, exp(-p.dt / {FIXED_RHO}) * xy as my, exp(-p.dt / {FIXED_RHO}) * xo as mo, exp(-2 * p.dt / {FIXED_RHO}) * pp + {p0} * (1 - exp(-2 * p.dt / {FIXED_RHO})) as pm, yy, yo, oo, l, n
    from {out} f join p on p.series_id = f.series_id and p.rn = f.rn + 1))),
{out}_l as (select series_id, k, tau, n, yo / oo as b0, -0.5 * (n * ln(2 * pi()) + l + yy - yo * yo / oo) as loglik from {out} qualify rn = max(rn) over (partition by series_id, k))"""

    parts = ["g0 as (select series_id, k, 0.05::double * exp(k * ln(100.0::double) / 40) as tau from (select distinct series_id from p), unnest(range(41)) as u(k))", filtered_over("g0", "f0")]
    for i in range(1, rounds):
        wide = f"(ln(100.0::double) / 40 / {10 ** (i - 1)})"
        parts.append(f"g{i} as (select series_id, k, best * exp((k - 10) / 10.0::double * {wide}) as tau from (select series_id, arg_max(tau, loglik) as best from f{i - 1}_l group by series_id), unnest(range(21)) as u(k))")
        parts.append(filtered_over(f"g{i}", f"f{i}"))
    parts.append(f"h as (select series_id, k, best * exp((k - 1) * 0.01::double) as tau from (select series_id, arg_max(tau, loglik) as best from f{rounds - 1}_l group by series_id), unnest(range(3)) as u(k))")
    parts.append(filtered_over("h", "e"))
    return f"with recursive s as ({LONG['nation_month'][1]}), {SQL_AXIS}, " + ",\n".join(parts) + """
select series_id, cast(any_value(n) as bigint) as n, 0 as outcome, round(max(case when k = 1 then loglik end), 4) as loglik, round(max(case when k = 1 then tau end), 3) as tau, round(max(case when k = 1 then b0 end), 4) + 0.0::double as b0,
  round(max(case when k = 1 then tau end) / sqrt((2 * max(case when k = 1 then loglik end) - max(case when k = 0 then loglik end) - max(case when k = 2 then loglik end)) / 0.0001::double), 2) as tau_err
from e_l group by series_id"""


@query(search_sql())
def q58_correlated_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit of a correlated model with a free parameter: derivatives, steps, curvature and errors, against a refined grid in SQL."""
    a, packed = standard_packed(spark, sf_dir)
    fits = fitting.fit(packed, fitting.planned(a, ["constant"]), [f"white + matern12(sigma={FIXED_SIGMA}, rho={FIXED_RHO})"])
    return fits.select("series_id", F.col("n").cast("long").alias("n"), "outcome", r("loglik", 4).alias("loglik"), r(F.col("theta")[0], 3).alias("tau"), (r(F.col("beta")[0], 4) + 0.0).alias("b0"), r(F.col("theta_err")[0], 2).alias("tau_err"))


SQL_FIELD = "select cast(c_nationkey as bigint) as series_id, cast(date_trunc('month', o_orderdate) as timestamp) as ts, sum(l_quantity) / 1e3::double as w from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2"


@query("with s as (" + LONG["nation_month"][1] + "), w as (" + SQL_FIELD + "), " + SQL_AXIS + """, f as (select p.series_id, z, w from p join axis using (i) join w on w.series_id = p.series_id and w.ts = axis.ts where w is not null)
select series_id, count(*) as n, 0 as outcome, round(regr_intercept(z, w), 5) + 0.0::double as b0, round(regr_slope(z, w), 5) + 0.0::double as b_field, round(sqrt((regr_syy(z, w) - regr_sxy(z, w) * regr_sxy(z, w) / regr_sxx(z, w)) / count(*) / regr_sxx(z, w)), 4) as b_field_err,
  round(-0.5 * count(*) * (ln(2 * pi()) + 1 + ln((regr_syy(z, w) - regr_sxy(z, w) * regr_sxy(z, w) / regr_sxx(z, w)) / count(*))), 3) as loglik from f group by series_id""")
def q59_field_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turnover of each nation on the quantity that its own orders hold: a design for each series."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    field = rows.groupBy(F.col("c_nationkey").cast("long").alias("series_id"), truncated("o_orderdate", "month").alias("ts")).agg((F.sum("l_quantity") / 1e3).cast("double").alias("w"))
    a, p = samples_of("nation_month", spark, sf_dir)
    p = p.where("z is not null").join(a.select("i", "ts"), "i").join(field, ["series_id", "ts"], "left_outer")
    packed = ops.pack(p.select("series_id", "i", "t", F.col("z").alias("v"), "w"), "w")
    fits = fitting.fit(packed, fitting.planned(a, ["constant"]), ["white"], fields=("w",))
    return fits.select("series_id", F.col("n").cast("long").alias("n"), "outcome", (r(F.col("beta")[0], 5) + 0.0).alias("b0"), (r(F.col("beta")[1], 5) + 0.0).alias("b_field"), r(F.col("beta_err")[1], 4).alias("b_field_err"), r("loglik", 3).alias("loglik"))


def calendar_sql() -> str:
    before = {"noleap": "0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334", "all_leap": "0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335", "360_day": "0, 30, 60, 90, 120, 150, 180, 210, 240, 270, 300, 330"}
    parts = [f"select '{c}' as calendar, y, m, d, case when d <= {last} then y + ([{days}][m] + d - 1) / {YEARS[c]}.0::double end as t from d" for (c, days), last in zip(before.items(), ("[31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]", "[31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]", "30"), strict=True)]
    return "with d as (select distinct cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m, cast(day(o_orderdate) as integer) as d from orders) select calendar, y, m, d, round(t, 8) as t from (" + " union all ".join(parts) + ")"


@query(calendar_sql())
def q60_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dates of orders as they are counted in calendars of equal years; dates that a calendar has not are NULL."""
    c = F.col("o_orderdate")
    dates = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.year(c).alias("y"), F.month(c).alias("m"), F.dayofmonth(c).alias("d")).distinct()
    each_calendar = [F.struct(F.lit(n).alias("calendar"), decimal_year(timestamp_of(F.col("y"), F.col("m"), F.col("d"), n), n).alias("t")) for n in map(calendar_of, YEARS)]
    return dates.select("y", "m", "d", F.inline(F.array(*each_calendar))).withColumn("t", r("t", 8))


@query(SQL_GRID + """, e as (select min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from pts),
whole as (select a.y, b.x from e, unnest(range(e.y0, e.y1 + 1)) as a(y), unnest(range(e.x0, e.x1 + 1)) as b(x))
select whole.y // 16 as ty, whole.x // 16 as tx, count(*) as n_places, cast(0 as bigint) as n_missing, count(*) - count(series_id) as n_extra from whole left join pts using (y, x) group by 1, 2""")
def q61_exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps the tiles of the whole grid from being an exact cover of the places that users are at."""
    points = points_of(spark, sf_dir)
    tiles = grid.rectangles(points, 16)
    odd = grid.tiled(grid.uncovered(tiles, points), 16).groupBy("ty", "tx").agg(F.sum("n_missing").alias("n_missing"), F.sum("n_extra").alias("n_extra"))
    out = tiles.withColumn("n_places", (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).join(odd, ["ty", "tx"], "left_outer")
    return out.select("ty", "tx", "n_places", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_missing", "n_extra")))
