"""Statistics, counts and metrics (A01-A22) and the flagship query."""

from pyspark.sql import functions as F

from sparkloom.functions.vectors import argmax, softmax
from sparkloom.operators import aggregates as agg, metrics as met
from sparkloom.operators.windows import lag_col, rolling
from sparkloom.plans.registry import query, rnd, rnd_sql, table

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("A01_describe", " union all ".join(f"""
select '{c}' as column_name, count({c}) as count, {rnd_sql(f'avg({c})')} as mean, {rnd_sql(f'stddev_samp({c})')} as std,
  min({c}) as min, {rnd_sql(f'quantile_cont({c}, 0.25)')} as q25, {rnd_sql(f'quantile_cont({c}, 0.5)')} as q50,
  {rnd_sql(f'quantile_cont({c}, 0.75)')} as q75, max({c}) as max from lineitem""" for c in NUMS))
def a01(spark, sf):
    d = agg.describe_table(table(spark, sf, "lineitem"), NUMS)
    return d.select("column_name", "count", rnd("mean").alias("mean"), rnd("std").alias("std"), "min",
                    rnd("q25").alias("q25"), rnd("q50").alias("q50"), rnd("q75").alias("q75"), "max")


@query("A02_value_counts", "select event_type, count(*) as count from events group by 1")
def a02(spark, sf):
    return agg.value_counts(table(spark, sf, "events"), "event_type")


@query("A03_unique", " union all ".join(
    f"select '{c}' as column_name, count(distinct {c}) as n_unique from orders"
    for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")))
def a03(spark, sf):
    return agg.n_unique(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"])


@query("A03_distinct_values", "select distinct p_brand from part")
def a03b(spark, sf):
    return agg.distinct_values(table(spark, sf, "part"), "p_brand")


@query("A04_group_calendar", " union all ".join(f"""
select '{p}' as part, {e}::int as v, {rnd_sql('avg(o_totalprice)')} as mean, count(*) as n from orders group by 2"""
    for p, e in (("weekday", "(isodow(o_orderdate) - 1)"), ("quarter", "quarter(o_orderdate)"))))
def a04(spark, sf):
    out = [agg.group_calendar(table(spark, sf, "orders"), "o_orderdate", p, [F.avg("o_totalprice").alias("m"), F.count("*").alias("n")])
           .select(F.lit(p).alias("part"), F.col(p).alias("v"), rnd("m").alias("mean"), "n") for p in ("weekday", "quarter")]
    return out[0].unionByName(out[1])


@query("A05_collapse_rare", """
with c as (select p_name, count(*) as n from part group by 1)
select p_partkey, case when n > 40 then p_name else 'OTHER' end as name from part join c using (p_name)""")
def a05(spark, sf):
    return agg.collapse_rare(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name")), "name", 40)


@query("A06_trim_quantiles", """
with b as (select quantile_cont(o_totalprice, 0.05) as lo, quantile_cont(o_totalprice, 0.95) as hi from orders)
select o_orderkey, o_totalprice from orders, b where o_totalprice < hi and o_totalprice > lo""")
def a06(spark, sf):
    return agg.trim_quantiles(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("A07_corr_matrix", " union all ".join(
    f"select '{a}' as x, '{b}' as y, {rnd_sql(f'corr({a}, {b})', 5)} as corr from lineitem" for a in NUMS for b in NUMS))
def a07(spark, sf):
    return agg.corr_matrix(table(spark, sf, "lineitem"), NUMS).withColumn("corr", rnd("corr", 5))


@query("A08_histogram", f"""
with e as (select l_returnflag as flag, min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem group by 1),
 b as (select flag, least(floor((l_extendedprice - lo) / ((hi - lo) / 20.0::double)), 19)::int as bin, lo, hi
       from lineitem join e on l_returnflag = flag)
select flag, bin, count(*) as n, {rnd_sql('any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 20', 2)} as left_edge
from b group by flag, bin""")
def a08(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return agg.histogram(df, "l_extendedprice", 20, "flag").withColumn("left_edge", rnd("left_edge", 2))


@query("A09_profile", " union all ".join(
    f"select '{c}' as column_name, '{t}' as dtype, count(*) as n_rows, count({c}) as non_null from events"
    for c, t in (("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
                 ("value", "double"), ("props", "string"))))
def a09(spark, sf):
    from sparkloom.operators.relational import profile
    return profile(table(spark, sf, "events"))


@query("A10_class_distribution", "select quality, count(*) as n from labels group by 1")
def a10(spark, sf):
    return agg.class_distribution(table(spark, sf, "labels"), "quality")


@query("A13_resample", f"""
with s as (select o_orderpriority as priority, date_trunc('month', o_orderdate)::date as p, sum(o_totalprice) as v
           from orders where o_orderstatus = 'F' group by 1, 2),
 b as (select priority, min(p) as lo, max(p) as hi from s group by 1),
 spine as (select priority, unnest(generate_series(lo, hi, interval 1 month))::date as p from b)
select spine.priority, (last_day(spine.p))::varchar as period, {rnd_sql('coalesce(v, 0)', 2)} as value
from spine left join s on s.priority = spine.priority and s.p = spine.p""")
def a13(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").withColumnRenamed("o_orderpriority", "priority")
    out = agg.resample(o, "o_orderdate", "M", F.sum("o_totalprice"), ["priority"])
    return out.select("priority", F.col("period").cast("string").alias("period"), rnd("value", 2).alias("value"))


DAILY = """(select o_orderpriority as priority, cast(o_orderdate as date) as d, sum(o_totalprice) as v from orders group by 1, 2)"""


def daily(spark, sf):
    return (table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("d"))
            .agg(F.sum("o_totalprice").alias("v")))


@query("A14_regression_metrics", f"""
with f as (select priority, v, lag(v) over (partition by priority order by d) as p from {DAILY})
select priority, count(*) as n, {rnd_sql('avg((v - p) * (v - p))', 0)} as mse, {rnd_sql('sqrt(avg((v - p) * (v - p)))')} as rmse,
  {rnd_sql('avg(abs(v - p))')} as mae, {rnd_sql('avg(abs((v - p) / v))')} as mape,
  {rnd_sql('1 - avg((v - p) * (v - p)) / var_pop(v)')} as r2
from f where p is not null group by priority""")
def a14(spark, sf):
    naive = lag_col(daily(spark, sf), "v", 1, ["priority"], ["d"], "p", calendar=True)
    m = met.regression_metrics(naive, "v", "p", ["priority"])
    return m.select("priority", "n", rnd("mse", 0).alias("mse"), *[rnd(c).alias(c) for c in ("rmse", "mae", "mape", "r2")])


PRED = """(select quality as y, case when n_chars > 2000 then 1 else 0 end as p
  from documents join labels using (doc_id))"""


def predictions(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("quality").alias("y"), F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("p"))


REPORT = f"""
with c as (select unnest([0, 1]) as class),
 t as (select class, count(*) filter (y = class and p = class) as tp, count(*) filter (y = class) as support,
              count(*) filter (p = class) as pn from c, {PRED} x group by class),
 r as (select *, case when pn > 0 then tp / pn else 0 end as precision, case when support > 0 then tp / support else 0 end as recall from t),
 f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from r)"""


@query("A15_class_report", f"""{REPORT}
select class, support, {rnd_sql('precision')} as precision, {rnd_sql('recall')} as recall, {rnd_sql('f1')} as f1 from f""")
def a15(spark, sf):
    rep = met.class_report(predictions(spark, sf), "y", "p")
    return rep.select("class", "support", *[rnd(c).alias(c) for c in ("precision", "recall", "f1")])


@query("A15_classification_metrics", f"""{REPORT}
select sum(support)::bigint as n, {rnd_sql('sum(tp) / sum(support)')} as accuracy,
 {rnd_sql('avg(precision)')} as macro_precision, {rnd_sql('avg(recall)')} as macro_recall, {rnd_sql('avg(f1)')} as macro_f1,
 {rnd_sql('sum(precision * support) / sum(support)')} as weighted_precision,
 {rnd_sql('sum(recall * support) / sum(support)')} as weighted_recall,
 {rnd_sql('sum(f1 * support) / sum(support)')} as weighted_f1,
 {rnd_sql('sum(tp) / sum(support)')} as micro_precision, {rnd_sql('sum(tp) / sum(support)')} as micro_recall,
 {rnd_sql('sum(tp) / sum(support)')} as micro_f1 from f""")
def a15b(spark, sf):
    m = met.classification_metrics(predictions(spark, sf), "y", "p")
    return m.select("n", *[rnd(c).alias(c) for c in m.columns if c != "n"])


@query("A16_confusion_matrix", f"""
select a.c as actual, b.c as predicted, count(y) as n
from (select unnest([0, 1]) as c) a cross join (select unnest([0, 1]) as c) b
left join {PRED} x on x.y = a.c and x.p = b.c group by 1, 2""")
def a16(spark, sf):
    return met.confusion_matrix(predictions(spark, sf), "y", "p")


@query("A17_auroc", f"""
with s as (select label, pos::int as class, embedding[pos + 1] as score
           from (select label, embedding, unnest(range(10)) as pos from embeddings)),
 r as (select class, label = class as is_pos, rank() over (partition by class order by score)
         + (count(*) over (partition by class, score) - 1) / 2.0 as rk from s)
select class, count(*) filter (is_pos) as support,
  {rnd_sql('(sum(rk) filter (is_pos) - count(*) filter (is_pos) * (count(*) filter (is_pos) + 1) / 2.0) / (count(*) filter (is_pos) * count(*) filter (not is_pos))', 6)} as auroc
from r group by class""")
def a17(spark, sf):
    df = table(spark, sf, "embeddings").select("label", F.slice("embedding", 1, 10).alias("scores"))
    return met.auroc_ovr(df, "scores", "label").select("class", "support", rnd("auroc", 6).alias("auroc"))


@query("A17_macro_auroc", f"""
with s as (select label, pos::int as class, embedding[pos + 1] as score
           from (select label, embedding, unnest(range(10)) as pos from embeddings)),
 r as (select class, label = class as is_pos, rank() over (partition by class order by score)
         + (count(*) over (partition by class, score) - 1) / 2.0 as rk from s),
 a as (select (sum(rk) filter (is_pos) - count(*) filter (is_pos) * (count(*) filter (is_pos) + 1) / 2.0)
         / nullif(count(*) filter (is_pos) * count(*) filter (not is_pos), 0) as auroc from r group by class)
select {rnd_sql('avg(auroc)', 6)} as auroc, count(auroc) as classes from a""")
def a17_macro(spark, sf):
    df = table(spark, sf, "embeddings").select("label", F.slice("embedding", 1, 10).alias("scores"))
    return met.macro_auroc(df, "scores", "label").select(rnd("auroc", 6).alias("auroc"), "classes")


@query("A17_recall_dice", f"""
with p as (select label as y, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 as p from embeddings)
select {rnd_sql('avg((y = p)::int)')} as recall, {rnd_sql('avg((y = p)::int)')} as dice from p""")
def a17b(spark, sf):
    df = table(spark, sf, "embeddings").select(F.col("label").alias("y"), argmax(F.slice("embedding", 1, 10)).alias("p"))
    return met.recall_dice(df, "y", "p").select(rnd("recall").alias("recall"), rnd("dice").alias("dice"))


@query("A18_binarize", """
select l_orderkey, l_partkey, l_linenumber, case when l_discount >= 0.05 then 1 else 0 end as at_least,
  case when l_discount > 0.05 then 1 else 0 end as above from lineitem""")
def a18(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", met.binarize("l_discount", 0.05).alias("at_least"),
        met.binarize("l_discount", 0.05, inclusive=False).alias("above"))


@query("A18_argmax_threshold", """
with e as (select vec_id, list_transform(embedding, lambda x: exp(x::double)) as e from embeddings)
select vec_id, case when list_max(e) / list_sum(e) >= 0.05 then list_position(e, list_max(e)) - 1 else -1 end::int as class from e""")
def a18b(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", softmax("embedding").alias("p"))
    return df.select("vec_id", F.when(F.array_max("p") >= 0.05, argmax("p")).otherwise(-1).alias("class"))


@query("A19_epoch_rollup", f"""
select cast(ts as date)::varchar as epoch, count(*) as steps, {rnd_sql('avg(value)')} as loss_mean,
  arg_max(value, event_id) as loss_last from events group by 1""")
def a19(spark, sf):
    log = table(spark, sf, "events").select(F.to_date("ts").cast("string").alias("epoch"), F.col("event_id").alias("step"),
                                            F.col("value").alias("loss"))
    out = agg.epoch_rollup(log, metrics=["loss"])
    return out.withColumn("loss_mean", rnd("loss_mean"))


FLAGSHIP = f"""
with s as (select o_orderpriority as priority, date_trunc('month', o_orderdate)::date as p, sum(o_totalprice) as v from orders group by 1, 2),
 spine as (select priority, unnest(generate_series(min(p), max(p), interval 1 month))::date as p from s group by priority),
 f as (select spine.priority, spine.p, coalesce(v, 0) as v from spine left join s on s.priority = spine.priority and s.p = spine.p),
 w as (select *, avg(v) over k as mean3, count(*) over k as n3, lag(v) over (partition by priority order by p) as naive
       from f window k as (partition by priority order by p rows between 2 preceding and current row)),
 m as (select priority, sqrt(avg((v - naive) * (v - naive))) as rmse from w where naive is not null group by 1)
select priority, last_day(p)::varchar as month, {rnd_sql('v', 2)} as value,
  {rnd_sql('case when n3 = 3 then mean3 end', 3)} as mean3, {rnd_sql('naive', 2)} as naive, {rnd_sql('rmse', 3)} as rmse
from w join m using (priority)"""


@query("flagship_monthly_value", FLAGSHIP)
def flagship(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "priority")
    monthly = agg.resample(o, "o_orderdate", "M", F.sum("o_totalprice"), ["priority"])
    smooth = rolling(monthly, "value", 3, ["priority"], ["period"], ("mean",), calendar=True)
    naive = lag_col(smooth, "value", 1, ["priority"], ["period"], "naive", calendar=True)
    errors = met.regression_metrics(naive, "value", "naive", ["priority"]).select("priority", "rmse")
    return naive.join(errors, "priority").select(
        "priority", F.col("period").cast("string").alias("month"), rnd("value", 2).alias("value"),
        rnd("value_mean3", 3).alias("mean3"), rnd("naive", 2).alias("naive"), rnd("rmse", 3).alias("rmse"))
