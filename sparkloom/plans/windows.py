"""Ordered analytics (W01-W06, W10): on calendar series and on raw events with hot keys."""

from pyspark.sql import functions as F

from sparkloom.operators import windows as win
from sparkloom.plans.aggregates import DAILY, daily
from sparkloom.plans.registry import query, rnd, rnd_sql, table

EV = "partition by event_type order by ts, event_id"
BY, ORDER = ["event_type"], ["ts", "event_id"]


@query("W01_lag_daily", f"""
select priority, d::varchar as day, {rnd_sql('lag(v, 1) over w', 3)} as lag1, {rnd_sql('lag(v, 7) over w', 3)} as lag7
from {DAILY} window w as (partition by priority order by d)""")
def w01(spark, sf):
    df = win.lag_col(daily(spark, sf), "v", 1, ["priority"], ["d"], "lag1", calendar=True)
    df = win.lag_col(df, "v", 7, ["priority"], ["d"], "lag7", calendar=True)
    return df.select("priority", F.col("d").cast("string").alias("day"), rnd("lag1", 3).alias("lag1"), rnd("lag7", 3).alias("lag7"))


@query("W01_lag_events", f"select event_id, lag(value, 7) over ({EV}) as lag7 from events")
def w01b(spark, sf):
    return win.lag_col(table(spark, sf, "events"), "value", 7, BY, ORDER, "lag7").select("event_id", "lag7")


@query("W02_diff", f"""
select event_id, {rnd_sql(f'value - lag(value) over ({EV})')} as d1,
  {rnd_sql(f'value - 2 * lag(value) over ({EV}) + lag(value, 2) over ({EV})')} as d2 from events""")
def w02(spark, sf):
    df = win.diff(table(spark, sf, "events"), "value", BY, ORDER, (1, 2))
    return df.select("event_id", rnd("value_diff1").alias("d1"), rnd("value_diff2").alias("d2"))


@query("W03_rolling", f"""
select event_id, {rnd_sql('case when n = 10 then m end')} as value_mean10, {rnd_sql('case when n = 10 then s end')} as value_std10
from (select event_id, avg(value) over w as m, stddev_samp(value) over w as s, count(value) over w as n from events
      window w as ({EV} rows between 9 preceding and current row))""")
def w03(spark, sf):
    df = win.rolling(table(spark, sf, "events"), "value", 10, BY, ORDER)
    return df.select("event_id", rnd("value_mean10").alias("value_mean10"), rnd("value_std10").alias("value_std10"))


@query("W04_cumsum", f"select event_id, {rnd_sql(f'sum(value) over ({EV} rows unbounded preceding)', 2)} as total from events")
def w04(spark, sf):
    return win.cumsum(table(spark, sf, "events"), "value", BY, ORDER, "total").select("event_id", rnd("total", 2).alias("total"))


@query("W05_detrend", f"""
with l as (select event_id, event_type, ts, case when value > 0 then ln(value) end as x from events)
select event_id, {rnd_sql('x')} as log_value, {rnd_sql(f'x - lag(x) over ({EV})')} as log_diff,
  {rnd_sql('case when count(x) over k = 7 then x - avg(x) over k end')} as log_detrended
from l window k as ({EV} rows between 6 preceding and current row)""")
def w05(spark, sf):
    df = win.detrend(table(spark, sf, "events"), "value", 7, BY, ORDER)
    return df.select("event_id", *[rnd(c).alias(c) for c in ("log_value", "log_diff", "log_detrended")])


@query("W06_invert_diff", f"""
with l as (select priority, d, ln(v) as x from {DAILY}),
 s as (select *, coalesce(x - lag(x) over w, 0) as dx, first_value(x) over w as x0 from l window w as (partition by priority order by d)),
 r as (select priority, d, exp(x0 + sum(dx) over (partition by priority order by d rows unbounded preceding)) as v from s)
select priority, d::varchar as day, {rnd_sql('v', 1)} as restored from r""")
def w06(spark, sf):
    df = win.detrend(daily(spark, sf), "v", 2, ["priority"], ["d"], calendar=True)
    out = win.invert_diff(df, "log_value", "log_diff", ["priority"], ["d"])
    return out.select("priority", F.col("d").cast("string").alias("day"), rnd("restored", 1).alias("restored"))


@query("W10_first_value", f"select event_id, first_value(value) over ({EV}) as first from events")
def w10(spark, sf):
    return win.first_value(table(spark, sf, "events"), "value", BY, ORDER, "first").select("event_id", "first")
