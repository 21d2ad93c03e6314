"""Time-series diagnostics and forecasts."""

from pyspark.sql import functions as F

from sparkloom.operators import timeseries as ts
from sparkloom.operators.aggregates import resample
from sparkloom.operators.metrics import cv_metrics, regression_metrics, signed_sum_error
from sparkloom.operators.windows import lag_col
from sparkloom.plans.registry import query, rnd, rnd_sql, table
from sparkloom.runtime import cut_lineage

KEY = ["priority"]


def series(spark, sf, freq="D"):
    """Order value per priority and calendar period, empty periods 0."""
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority")
    s = resample(o, "o_orderdate", freq, F.sum("o_totalprice"), KEY, name="y", label="start").withColumnRenamed("period", "ds")
    return cut_lineage(s)  # calendar-sized: stored once for the passes of a fit


def _spine(unit):
    cut = "cast(o_orderdate as date)" if unit == "day" else f"date_trunc('{unit}', o_orderdate)::date"
    return f"""(select sp.priority, sp.ds, coalesce(s.y, 0) as y from (
   select priority, unnest(generate_series(min(ds), max(ds), interval 1 {unit}))::date as ds from (
     select o_orderpriority as priority, {cut} as ds from orders) group by priority) sp
  left join (select o_orderpriority as priority, {cut} as ds, sum(o_totalprice) as y from orders group by 1, 2) s
    on s.priority = sp.priority and s.ds = sp.ds)"""


DAY, MONTH = _spine("day"), _spine("month")


def day_text(df):
    return df.withColumn("ds", F.col("ds").cast("string"))


@query("E01_adf_lag0", f"""
with d as (select priority, y - lag(y) over w as dy, lag(y) over w as p from {DAY} window w as (partition by priority order by ds)),
 r as (select priority, regr_slope(dy, p) as b, regr_sxx(dy, p) as sxx, regr_syy(dy, p) as syy, count(p) as n from d where p is not null group by 1)
select priority, n as n_obs, {rnd_sql('b / sqrt((syy - b * b * sxx) / (n - 2) / sxx)', 3)} as adf_stat from r""")
def e01(spark, sf):
    out = ts.adf_test(series(spark, sf), KEY, "ds", "y", max_lag=0, auto_lag=False)
    return out.select("priority", "n_obs", rnd("adf_stat", 3).alias("adf_stat"))


@query("E01_stationarity_report")
def e01b(spark, sf):
    rows, tests = ts.stationarity_report(series(spark, sf), KEY, "ds", "y")
    known = rows.groupBy(*KEY).agg(F.count("y_mean10").alias("smoothed_rows"))
    return tests.join(known, KEY)


@query("E02_seasonal_decompose", f"""
with w as (select *, row_number() over k - 1 as i, count(*) over c as n, sum(y) over c as s, lag(y, 6) over k as a, lead(y, 6) over k as b
           from {MONTH} window k as (partition by priority order by ds), c as (partition by priority order by ds rows between 6 preceding and 6 following)),
 t as (select priority, ds, y, i % 12 as ph, case when n = 13 then (s - 0.5::double * (a + b)) / 12 end as trend from w),
 m as (select priority, ph, avg(y - trend) as s from t group by 1, 2),
 z as (select priority, ph, s - avg(s) over (partition by priority) as seasonal from m)
select t.priority, t.ds::varchar as ds, {rnd_sql('trend', 2)} as trend, {rnd_sql('seasonal', 2)} as seasonal, {rnd_sql('y - trend - seasonal', 2)} as resid
from t join z using (priority, ph)""")
def e02(spark, sf):
    out = ts.seasonal_decompose(series(spark, sf, "M"), KEY, "ds", "y", 12)
    return day_text(out).select("priority", "ds", *[rnd(c, 2).alias(c) for c in ("trend", "seasonal", "resid")])


@query("E03_acf", " union all ".join(f"""
select priority, {k} as lag, {rnd_sql('sum((y - m) * (l - m)) / any_value(v)', 6)} as acf from (
  select priority, y, lag(y, {k}) over (partition by priority order by ds) as l, avg(y) over (partition by priority) as m,
         var_pop(y) over (partition by priority) * count(*) over (partition by priority) as v from {DAY}) group by priority""" for k in range(0, 15)))
def e03(spark, sf):
    return ts.acf(series(spark, sf), KEY, "ds", "y", 14).withColumn("acf", rnd("acf", 6))


@query("E03_pacf", f"""
with recursive c as (select priority, ds, y - avg(y) over (partition by priority) as z from {DAY}),
 k as (select priority, lag, sum(z * l) as s from (select priority, z, lag, lag(z, lag) over (partition by priority, lag order by ds) as l
       from c, (select unnest(range(0, 15)) as lag)) group by all),
 a as (select priority, list(s / s0 order by lag) as r from k join (select priority, s as s0 from k where lag = 0) using (priority) group by 1),
 d as (select priority, r, 0::bigint as k, []::double[] as phi, 1::double as last from a
  union all
  select priority, r, k + 1, list_transform(range(1, k + 1), lambda j: phi[j] - v * phi[k + 1 - j]) || [v], v
  from (select *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0))
          / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1])), 0)) as v from d where k < 14))
select priority, k::int as lag, {rnd_sql('last', 6)} as pacf from d""")
def e03b(spark, sf):
    return ts.pacf(series(spark, sf), KEY, "ds", "y", 14).withColumn("pacf", rnd("pacf", 6))


@query("E04_ar1", f"""
with l as (select priority, y, lag(y) over (partition by priority order by ds) as p from {DAY})
select priority, {rnd_sql('regr_intercept(y, p)', 1)} as constant, {rnd_sql('regr_slope(y, p)', 6)} as slope, regr_count(y, p)::bigint as n from l group by 1""")
def e04(spark, sf):
    m = ts.fit_ar(series(spark, sf), KEY, "ds", "y", max_p=1, max_d=0, min_p=1)
    return m.select("priority", rnd(F.get("coef", F.lit(0)), 1).alias("constant"), rnd(F.get("coef", F.lit(1)), 6).alias("slope"), "n")


@query("E04_fit_ar")
def e04b(spark, sf):
    return ts.fit_ar(series(spark, sf), KEY, "ds", "y", max_p=5, max_d=1)


@query("E04_ar_fitted")
def e04c(spark, sf):
    s = series(spark, sf)
    return ts.ar_fitted(s, KEY, "ds", "y", ts.fit_ar(s, KEY, "ds", "y", 3, 1), 3, 1)


SES = f"""
s as (select priority, ds, y, row_number() over (partition by priority order by ds) as i from {DAY}),
r as (select priority, i, ds, y, a, y as fitted, y as level from s, (select unnest([0.2::double, 0.8::double]) as a) where i = 1
  union all select s.priority, s.i, s.ds, s.y, r.a, r.level, r.a * s.y + (1 - r.a) * r.level from r join s on s.priority = r.priority and s.i = r.i + 1)"""


@query("E05_ses", f"with recursive {SES} select priority, a as alpha, ds::varchar as ds, {rnd_sql('fitted', 3)} as fitted, {rnd_sql('level', 3)} as level from r")
def e05(spark, sf):
    s = series(spark, sf)
    out = [day_text(ts.ses(s, KEY, "ds", "y", a)).select("priority", F.lit(a).alias("alpha"), "ds", rnd("fitted", 3).alias("fitted"),
                                                         rnd("level", 3).alias("level")) for a in (0.2, 0.8)]
    return out[0].unionByName(out[1])


@query("E05_ses_forecast", f"""with recursive {SES} select priority, step::int as step, {rnd_sql('level', 3)} as forecast
from (select priority, arg_max(level, i) as level from r where a = 0.2::double group by 1), (select unnest([1, 2, 3]) as step)""")
def e05b(spark, sf):
    out = ts.ses_forecast(ts.ses(series(spark, sf), KEY, "ds", "y", 0.2), KEY, "ds", 3)
    return out.withColumn("forecast", rnd("forecast", 3))


@query("E06_holt_winters_fixed", f"""
with recursive s as (select priority, list(y order by ds) as y from {MONTH} group by 1 having min(y) > 0),
 r as (select priority, y, 0 as i, list_sum(y[1:12]) / 12 as l, (list_sum(y[13:24]) - list_sum(y[1:12])) / 144 as b,
         list_transform(y[1:12], lambda v: v / (list_sum(y[1:12]) / 12)) as se, 0::double as sse from s
  union all
  select priority, y, i + 1, 0.3::double * y[i + 1] / se[i % 12 + 1] + 0.7::double * (l + b),
    0.1::double * (0.3::double * y[i + 1] / se[i % 12 + 1] + 0.7::double * (l + b) - l) + 0.9::double * b,
    list_transform(range(12), lambda k: case when k = i % 12 then 0.2::double * y[i + 1] / (l + b) + 0.8::double * se[k + 1] else se[k + 1] end),
    sse + (y[i + 1] - (l + b) * se[i % 12 + 1]) ** 2
  from r where i < len(y))
select priority, step::int as step, {rnd_sql('(l + step * b) * se[(i + step - 1) % 12 + 1]', 2)} as forecast, null::varchar as reason
from r, (select unnest(range(1, 37)) as step) where i = len(y)
union all select priority, step::int, null, 'a value is not positive' from (select priority from {MONTH} group by 1 having min(y) <= 0), (select unnest(range(1, 37)) as step)""")
def e06(spark, sf):
    out = ts.holt_winters(series(spark, sf, "M"), KEY, "ds", "y", 12, [(0.3, 0.1, 0.2)], 36)
    return out.select("priority", "step", rnd("forecast", 2).alias("forecast"), "reason")


@query("E06_holt_winters", f"""
with recursive s as (select priority, list(y order by ds) as y from {MONTH} group by 1 having min(y) > 0),
 g as (select unnest([0.1::double, 0.3::double, 0.5::double, 0.7::double, 0.9::double]) as v),
 r as (select priority, y, a.v as alpha, b.v as beta, c.v as gamma, 0 as i, list_sum(y[1:12]) / 12 as l,
         (list_sum(y[13:24]) - list_sum(y[1:12])) / 144 as t, list_transform(y[1:12], lambda v: v / (list_sum(y[1:12]) / 12)) as se, 0::double as sse
       from s, g a, g b, g c
  union all
  select priority, y, alpha, beta, gamma, i + 1, n, beta * (n - l) + (1 - beta) * t,
    list_transform(range(12), lambda k: case when k = i % 12 then gamma * y[i + 1] / (l + t) + (1 - gamma) * se[k + 1] else se[k + 1] end),
    sse + (y[i + 1] - (l + t) * se[i % 12 + 1]) ** 2
  from (select *, alpha * y[i + 1] / se[i % 12 + 1] + (1 - alpha) * (l + t) as n from r where i < len(y))),
 best as (select *, row_number() over (partition by priority order by sse, alpha, beta, gamma) as rk from r where i = len(y))
select priority, alpha, beta, gamma, step::int as step, {rnd_sql('(l + step * t) * se[(i + step - 1) % 12 + 1]', 1)} as forecast, null::varchar as reason
from best, (select unnest(range(1, 37)) as step) where rk = 1
union all select priority, null, null, null, step::int, null, 'a value is not positive' from (select priority from {MONTH} group by 1 having min(y) <= 0), (select unnest(range(1, 37)) as step)""")
def e06b(spark, sf):
    out = ts.holt_winters(series(spark, sf, "M"), KEY, "ds", "y", 12, horizon=36)
    return out.select("priority", "alpha", "beta", "gamma", "step", rnd("forecast", 1).alias("forecast"), "reason")


@query("E07_naive_forecast", f"""
with f as (select priority, y, lag(y) over (partition by priority order by ds) as p from {DAY})
select priority, count(*) as n, {rnd_sql('sqrt(avg((y - p) ** 2))', 3)} as rmse, {rnd_sql('avg(abs(y - p))', 3)} as mae
from f where p is not null group by 1""")
def e07(spark, sf):
    _, errors = ts.naive_forecast(series(spark, sf), KEY, "ds", "y")
    return errors.select("priority", "n", rnd("rmse", 3).alias("rmse"), rnd("mae", 3).alias("mae"))


@query("E08_future_frame", f"""
select priority, ds::varchar as ds from {DAY} union all
select priority, cast(cast(unnest(generate_series(hi + interval 1 day, hi + interval 500 day, interval 1 day)) as date) as varchar)
from (select priority, max(ds) as hi from {DAY} group by 1)""")
def e08(spark, sf):
    return day_text(ts.future_frame(series(spark, sf).select("priority", "ds"), KEY, "ds", 500))


@query("E09_fourier_forecast")
def e09(spark, sf):
    return day_text(ts.fourier_forecast(series(spark, sf), KEY, "ds", "y", 500))


ORIGINS = f"""
b as (select priority, min(ds) as lo, max(ds) as hi from {DAY} group by 1),
cuts as (select priority, (hi - 365 - 180 * j)::date as cutoff from b, (select unnest(range(0, 100))::int as j) where hi - 365 - 180 * j >= lo + 1095),
test as (select c.priority, c.cutoff, s.ds, s.y from cuts c join {DAY} s on s.priority = c.priority and s.ds > c.cutoff and s.ds <= c.cutoff + 365)"""


@query("J13_rolling_origin", f"with {ORIGINS} select priority, cutoff::varchar as cutoff, ds::varchar as ds, {rnd_sql('y', 2)} as y from test")
def j13(spark, sf):
    out = ts.rolling_origin(series(spark, sf), KEY, "ds", 1095, 180, 365)
    return day_text(out).select("priority", F.col("cutoff").cast("string").alias("cutoff"), "ds", rnd("y", 2).alias("y"))


NAIVE_CV = f"""{ORIGINS}, last as (select c.priority, c.cutoff, arg_max(s.y, s.ds) as yhat from cuts c
  join {DAY} s on s.priority = c.priority and s.ds <= c.cutoff group by 1, 2),
 cv as (select t.*, yhat from test t join last using (priority, cutoff))"""


@query("E10_cross_validate", f"with {NAIVE_CV} select priority, cutoff::varchar as cutoff, ds::varchar as ds, {rnd_sql('y', 2)} as y, {rnd_sql('yhat', 2)} as yhat from cv")
def e10(spark, sf):
    out = ts.cross_validate(series(spark, sf), KEY, "ds", "y")
    return day_text(out).select("priority", F.col("cutoff").cast("string").alias("cutoff"), "ds", rnd("y", 2).alias("y"), rnd("yhat", 2).alias("yhat"))


@query("E10_cross_validate_fourier")
def e10b(spark, sf):
    out = ts.cross_validate(series(spark, sf), KEY, "ds", "y", forecaster="fourier")
    return day_text(out).withColumn("cutoff", F.col("cutoff").cast("string"))


@query("A21_cv_metrics", f"""with {NAIVE_CV}
select priority, (ceil((ds - cutoff) / 30.0))::bigint as bucket, count(*) as n, {rnd_sql('avg((y - yhat) ** 2)', 0)} as mse,
  {rnd_sql('sqrt(avg((y - yhat) ** 2))', 2)} as rmse, {rnd_sql('avg(abs(y - yhat))', 2)} as mae,
  {rnd_sql('avg((y between yhat * 0.5::double and yhat * 1.5::double)::int)')} as coverage from cv group by 1, 2""")
def a21(spark, sf):
    cv = ts.cross_validate(series(spark, sf), KEY, "ds", "y").withColumns({
        "bucket": F.ceil(F.datediff("ds", "cutoff") / 30.0), "lower": F.col("yhat") * 0.5, "upper": F.col("yhat") * 1.5})
    m = cv_metrics(cv, ["priority", "bucket"], lower="lower", upper="upper")
    return m.select("priority", "bucket", "n", rnd("mse", 0).alias("mse"), rnd("rmse", 2).alias("rmse"), rnd("mae", 2).alias("mae"),
                    rnd("coverage").alias("coverage"))


@query("E11_signed_sum_error", f"""
with f as (select priority, y, lag(y) over (partition by priority order by ds) as p from {DAY})
select priority, {rnd_sql('sqrt(sum(p - y) ** 2 / count(*))', 2)} as signed_sum_error from f where p is not null group by 1""")
def e11(spark, sf):
    rows = lag_col(series(spark, sf), "y", 1, KEY, ["ds"], "p", calendar=True).filter("p is not null")
    return signed_sum_error(rows, "y", "p", KEY).withColumn("signed_sum_error", rnd("signed_sum_error", 2))


@query("E12_segment_series", """
with r as (select *, (row_number() over (partition by event_type order by ts, event_id) - 1) // 24 as segment from events)
select event_type, segment, string_agg((value * 100)::bigint::varchar, ',' order by ts, event_id) as values from r group by 1, 2""")
def e12(spark, sf):
    df = table(spark, sf, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    out = ts.segment_series(df, ["event_type"], ["ts", "event_id"], "cents", 24)
    return out.select("event_type", "segment", F.array_join(F.col("values").cast("array<string>"), ",").alias("values"))
