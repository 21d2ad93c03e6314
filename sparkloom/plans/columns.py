"""Projections, predicates, nulls and conditionals."""

from functools import reduce

from pyspark.sql import functions as F

from sparkloom.operators import relational as rel
from sparkloom.plans.registry import query, rnd, rnd_sql, table
from sparkloom.sources import files


@query("P01_select_cols", "select o_orderkey, o_custkey, o_totalprice from orders")
def p01(spark, sf):
    return rel.select_cols(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query("P02_slice_cols", "select p_name, p_brand, p_type, p_size from part")
def p02(spark, sf):
    return rel.slice_cols(table(spark, sf, "part"), 1, -1)


@query("P03_drop_cols", "select c_custkey, c_name, c_nationkey from customer")
def p03(spark, sf):
    return rel.drop_cols(table(spark, sf, "customer"), ["c_acctbal", "c_mktsegment"])


@query("P04_rename", "select cast(o_orderdate as date)::varchar as ds, o_totalprice as y, o_orderkey from orders")
def p04(spark, sf):
    df = table(spark, sf, "orders").select(F.to_date("o_orderdate").cast("string").alias("o_orderdate"),
                                           "o_totalprice", "o_orderkey")
    return rel.rename(df, {"o_orderdate": "ds", "o_totalprice": "y"})


@query("P05_with_age", "select o_orderkey, year(o_orderdate)::int as year, "
       "(2021 - year(o_orderdate) + 1)::int as age from orders")
def p05(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return rel.with_age(df, "year", 2021)


@query("P06_filters", "select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem "
       "where l_returnflag <> 'N' and l_quantity >= 25 and l_shipdate < timestamp '1999-01-01'")
def p06(spark, sf):
    return (table(spark, sf, "lineitem")
            .filter("l_returnflag != 'N' and l_quantity >= 25 and l_shipdate < timestamp_ntz '1999-01-01 00:00:00'")
            .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))


@query("P08_columns_of_type", """
select p_partkey, md5(concat_ws('|', p_name, p_brand, p_type)) as text_columns, p_partkey as whole_columns,
  cast(floor(p_retailprice * 100 + 0.5) as bigint) as float_cents from part""")
def p08(spark, sf):
    part = table(spark, sf, "part")
    text, whole, floats = (part.select(*rel.columns_of_type(part, k)).columns for k in ("object", "int64", "float"))
    total = reduce(lambda a, b: a + b, [F.col(c) for c in floats])
    return part.select("p_partkey", F.md5(F.concat_ws("|", *text)).alias("text_columns"),
                       reduce(lambda a, b: a + b, [F.col(c) for c in whole]).alias("whole_columns"),
                       F.floor(total * 100 + 0.5).cast("bigint").alias("float_cents"))


@query("P09_cast_cols", "select o_orderkey::varchar as key_text, round(o_totalprice)::bigint as price_up, "
       "try_cast(o_orderpriority as bigint) as bad, trunc(o_totalprice)::bigint as price_int from orders")
def p09(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key_text"), F.round("o_totalprice").alias("price_up"),
        F.col("o_orderpriority").alias("bad"), F.col("o_totalprice").alias("price_int"))
    return rel.cast_cols(df, {"key_text": "string", "price_up": "bigint", "bad": "bigint", "price_int": "bigint"})


@query("P10_map_values", "select o_orderkey, case o_orderstatus when 'F' then 'filled' when 'O' then 'open' end "
       "as status from orders")
def p10(spark, sf):
    df = rel.map_values(table(spark, sf, "orders"), "o_orderstatus", {"F": "filled", "O": "open"}, "status")
    return df.select("o_orderkey", "status")


@query("P11_label_when", """
select event_id, case when isodow(ts) >= 6 then 'weekend' else 'weekday' end as day_kind,
       case when event_type = 'purchase' then 'red' when event_type = 'error' then 'gray' else 'blue' end as color,
       case when value > 20 then 1 else 0 end as high from events""")
def p11(spark, sf):
    df = table(spark, sf, "events")
    df = rel.label_when(df, "day_kind", [(F.weekday("ts") >= 5, "weekend")], "weekday")
    df = rel.label_when(df, "color", [(F.col("event_type") == "purchase", "red"),
                                      (F.col("event_type") == "error", "gray")], "blue")
    df = rel.label_when(df, "high", [(F.col("value") > 20, 1)], 0)
    return df.select("event_id", "day_kind", "color", "high")


@query("P12_parse_number", """
select p_partkey, raw, coalesce(try_cast(raw as double),
       try_cast(nullif(regexp_extract(string_split(raw, ' ')[1], '([0-9]+)', 1), '') as double)) as number
from (select p_partkey, unnest([p_brand, p_type, p_size::varchar || ' - ' || (p_size + 10)::varchar,
                                p_retailprice::varchar, p_size::varchar || 'Sq. Meter']) as raw from part)""")
def p12(spark, sf):
    size = F.col("p_size").cast("string")
    raws = F.array("p_brand", "p_type", F.concat(size, F.lit(" - "), (F.col("p_size") + 10).cast("string")),
                   F.col("p_retailprice").cast("string"), F.concat(size, F.lit("Sq. Meter")))
    return (table(spark, sf, "part").select("p_partkey", F.explode(raws).alias("raw"))
            .withColumn("number", rel.parse_number("raw")))


@query("P13_min_chars", "select doc_id, lang, len(text)::int as chars from documents where len(text) >= 500")
def p13(spark, sf):
    return rel.filter_min_chars(table(spark, sf, "documents"), "text", 500) \
        .select("doc_id", "lang", F.length("text").alias("chars"))


@query("P14_scalar_math", f"""
select l_orderkey, l_partkey, l_linenumber, {rnd_sql('ln(l_extendedprice)', 6)} as log_price,
       {rnd_sql('exp(l_discount)', 6)} as exp_discount, {rnd_sql('sqrt(l_quantity)', 6)} as root_quantity,
       round_even(l_quantity / 2, 0) as half, greatest(l_quantity - 25, 0::double) as relu,
       {rnd_sql('1 / (1 + exp(-(l_quantity - 25) / 10))', 6)} as sigmoid
from lineitem""")
def p14(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", rnd(rel.log_or_null(F.col("l_extendedprice")), 6).alias("log_price"),
        rnd(F.exp("l_discount"), 6).alias("exp_discount"), rnd(F.sqrt(q), 6).alias("root_quantity"),
        F.bround(q / 2).alias("half"), rel.relu(q - 25).alias("relu"),
        rnd(rel.sigmoid((q - 25) / 10), 6).alias("sigmoid"))


OUTER = """from customer left join (select o_custkey, o_orderkey, o_totalprice, o_orderstatus from orders) on c_custkey = o_custkey"""


def customers_with_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return c.join(o, c.c_custkey == o.o_custkey, "left")


@query("P15_null_counts", " union all ".join(
    f"select '{c}' as column_name, count(*) - count({c}) as nulls {OUTER}"
    for c in ("c_custkey", "c_mktsegment", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")))
def p15(spark, sf):
    return rel.null_counts(customers_with_orders(spark, sf))


@query("P16_dropna_any", f"select c_custkey, o_orderkey, o_totalprice {OUTER} where o_orderkey is not null")
def p16(spark, sf):
    return rel.dropna_any(customers_with_orders(spark, sf)).select("c_custkey", "o_orderkey", "o_totalprice")


@query("P17_backfill", """
select event_id, event_type, coalesce(v, first_value(v ignore nulls) over (
         partition by event_type order by ts, event_id rows between 1 following and unbounded following)) as filled
from (select *, case when value >= 30 then value end as v from events)""")
def p17(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "ts", F.expr(
        "case when value >= 30 then value end").alias("filled"))
    return rel.backfill(df, ["filled"], ["ts", "event_id"], ["event_type"]).drop("ts")


@query("P18_build_prompts", """
select o_orderkey, 'My age is ' || c_nationkey || ' . My gender is ' || case when c_mktsegment = 'MACHINERY'
         then 'Male' else 'Female' end || ' . My occupation is ' || c_mktsegment as user_text,
       'The movie title is ' || o_orderpriority || ' . The genre of the movie is ' || o_orderstatus || ', ' ||
         c_mktsegment || ' . I have given the movie-rating to ' || (year(o_orderdate) - 1994 - 1) as item_text,
       (year(o_orderdate) - 1994 - 1)::int as rating_class
from orders join customer on o_custkey = c_custkey""")
def p18(spark, sf):
    df = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    df = df.select("o_orderkey", "c_nationkey", F.when(F.col("c_mktsegment") == "MACHINERY", "M").otherwise("F")
                   .alias("gender"), "c_mktsegment", "o_orderpriority",
                   F.array("o_orderstatus", "c_mktsegment").alias("genres"),
                   (F.year("o_orderdate") - 1994).alias("rating"))
    out = rel.build_prompts(df, "c_nationkey", "gender", "c_mktsegment", "o_orderpriority", "genres", "rating")
    return out.select("o_orderkey", "user_text", "item_text", "rating_class")


@query("P19_active_flags", """
select l_orderkey, l_partkey, l_linenumber, concat_ws(', ', case when l_quantity > 25 then 'bulk' end,
       case when l_discount >= 0.05 then 'discounted' end, case when l_returnflag = 'R' then 'returned' end) as flags
from lineitem""")
def p19(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", (F.col("l_quantity") > 25).cast("int").alias("bulk"),
        (F.col("l_discount") >= 0.05).cast("int").alias("discounted"),
        (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return df.select("l_orderkey", "l_partkey", "l_linenumber",
                     F.array_join(rel.active_flags(["bulk", "discounted", "returned"]), ", ").alias("flags"))


@query("P20_scale_array", f"select vec_id, pos::int as pos, {rnd_sql('embedding[pos + 1]::double / 255', 9)} as x "
       "from (select vec_id, embedding, unnest(range(len(embedding))) as pos from embeddings)")
def p20(spark, sf):
    from sparkloom.functions.vectors import scale_array
    scaled = scale_array("embedding", 255.0)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(scaled).alias("pos", "x")) \
        .withColumn("x", rnd("x", 9))


@query("P21_export_hosts", "select hostname as original, upper(hostname) as \"upperHostname\" from (select "
       "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as hostname from pages) order by hostname limit 10")
def p21(spark, sf):
    table(spark, sf, "pages").select(F.expr("parse_url(url, 'HOST')").alias("hostname")) \
        .createOrReplaceTempView("hosts_view")
    return files.export_hosts(spark, "hosts_view", limit=10)


@query("P22_calendar_parts", """
select event_id, (isodow(ts) - 1)::int as day_of_week, quarter(ts)::int as quarter, month(ts)::int as month,
       year(ts)::int as year, dayname(ts) as day_name,
       strftime(to_timestamp(floor(epoch(ts)))::timestamp, '%Y-%m-%d %H:%M:%S') as from_epoch from events""")
def p22(spark, sf):
    df = rel.calendar_parts(table(spark, sf, "events"), "ts")
    back = rel.from_epoch(F.unix_timestamp("ts")).cast("timestamp_ntz")
    return df.select("event_id", "day_of_week", "quarter", "month", "year", "day_name",
                     F.date_format(back, "yyyy-MM-dd HH:mm:ss").alias("from_epoch"))


@query("P23_row_at", "select event_id, user_id, value from events order by ts, event_id limit 1 offset 777")
def p23(spark, sf):
    return rel.row_at(table(spark, sf, "events"), ["ts", "event_id"], 777).select("event_id", "user_id", "value")


@query("P24_top_class", f"""
with s as (select vec_id, embedding, list_transform(embedding, lambda x: exp(x::double)) as e from embeddings)
select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as class,
       {rnd_sql('list_max(e) / list_sum(e)', 3)} as confidence from s""")
def p24(spark, sf):
    from sparkloom.functions.vectors import softmax, top_class
    df = table(spark, sf, "embeddings").select("vec_id", softmax("embedding").alias("p"))
    return top_class(df, "p", digits=None).select("vec_id", "class", rnd("confidence", 3).alias("confidence"))
