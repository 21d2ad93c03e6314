"""Joins, sorts and set operations (J, T, U)."""

from pyspark.sql import functions as F

from sparkloom.operators import relational as rel
from sparkloom.operators.ordered import with_ordinal
from sparkloom.operators.skew import dimension_join
from sparkloom.plans.registry import query, rnd, rnd_sql, table


def ratings(spark, sf):
    """Orders as users' ratings of parts: user, item, rating 1-5."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    rating = (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int")
    return dimension_join(li, o, "l_orderkey").select(
        "user_id", F.col("l_partkey").alias("movie_id"), rating.alias("rating"), "l_orderkey", "l_linenumber")


RATINGS = """(select o_custkey as user_id, l_partkey as movie_id, (1 + floor((l_quantity - 1) / 10))::int as rating,
  l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey)"""


@query("J01_join_users", "select o_orderkey, o_totalprice, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey")
def j01(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("user_id"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return rel.join_users(o, c)


@query("J02_rating_user_item", f"""
select user_id, movie_id, rating, l_orderkey, l_linenumber, c_mktsegment, p_brand
from {RATINGS} join customer on user_id = c_custkey join part on movie_id = p_partkey""")
def j02(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("movie_id"), "p_brand")
    return rel.rating_user_item(ratings(spark, sf), users, items)


SOURCING = """
with imp as (select p_partkey as pos, p_name || ' ' || p_brand as name, p_size as quantity, floor(p_retailprice)::bigint as price
             from part where p_size % 2 = 0),
 man as (select p_partkey as pos, upper(p_name || ' ' || p_brand) as name, p_size + 5 as quantity,
                floor(p_retailprice)::bigint - 100 as price from part where p_size % 2 = 1),
 firsts as (select lower(name) as k, min(pos) as pos from man group by 1),
 f as (select k, m.pos, m.quantity as mq, m.price as mc from firsts join man m using (pos)),
 paid as (select case when f.k is null then price * quantity
            when quantity < mq then {below}
            else mc * mq + abs(mq - quantity) * price end as cost
          from imp left join f on lower(imp.name) = f.k),
 spare as (select price * quantity as cost from man
           where pos not in (select f.pos from f join imp on lower(imp.name) = f.k))
select '{mode}' as mode, sum(cost)::bigint as total_cost from (select cost from paid union all select cost from spare)"""


def _sourcing(spark, sf, mode):
    p = table(spark, sf, "part")
    name = F.concat_ws(" ", "p_name", "p_brand")
    price = F.floor("p_retailprice")
    imports = p.filter("p_size % 2 = 0").select(
        F.col("p_partkey").alias("pos"), name.alias("name"), F.col("p_size").cast("bigint").alias("quantity"), price.alias("price"))
    made = p.filter("p_size % 2 = 1").select(
        F.col("p_partkey").alias("pos"), F.upper(name).alias("name"), (F.col("p_size") + 5).cast("bigint").alias("quantity"),
        (price - 100).alias("price"))
    return rel.sourcing_budget(imports, made, mode).select(F.lit(mode).alias("mode"), "total_cost")


@query("J03_sourcing_budget", SOURCING.format(mode="as_coded", below="mq * quantity"))
def j03(spark, sf):
    return _sourcing(spark, sf, "as_coded")


@query("J03_sourcing_budget_intended", SOURCING.format(mode="intended", below="mc * quantity"))
def j03b(spark, sf):
    return _sourcing(spark, sf, "intended")


DAILY_F = "select cast(o_orderdate as date) as d, sum(o_totalprice) as value from orders where o_orderstatus = '{s}' group by 1"


def _daily(spark, sf, status):
    return (table(spark, sf, "orders").filter(F.col("o_orderstatus") == status)
            .groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("value")))


@query("J06_aligned_add", f"""
select coalesce(a.d, b.d)::varchar as day, {rnd_sql('coalesce(a.value, 0) + coalesce(b.value, 0)', 3)} as value
from ({DAILY_F.format(s='F')}) a full join ({DAILY_F.format(s='O')}) b on a.d = b.d""")
def j06(spark, sf):
    out = rel.aligned_add(_daily(spark, sf, "F"), _daily(spark, sf, "O"), ["d"], fill=0.0)
    return out.select(F.col("d").cast("string").alias("day"), rnd("value", 3).alias("value"))


@query("J07_align", f"""
select coalesce(a.d, b.d)::varchar as day, {rnd_sql('a.value', 3)} as filled, {rnd_sql('b.value', 3)} as open
from ({DAILY_F.format(s='F')}) a full join ({DAILY_F.format(s='O')}) b on a.d = b.d""")
def j07(spark, sf):
    out = rel.align({"filled": _daily(spark, sf, "F"), "open": _daily(spark, sf, "O")}, ["d"])
    return out.select(F.col("d").cast("string").alias("day"), rnd("filled", 3).alias("filled"), rnd("open", 3).alias("open"))


@query("J12_attach_response", """
with resp as (select role as intent, text as response, row_number() over (partition by role order by conv_id, turn) - 1 as pos from conversations),
 n as (select intent, count(*) as n from resp group by 1)
select c.conv_id, c.turn, r.response from conversations c join n on n.intent = c.role
join resp r on r.intent = c.role and r.pos = ('0x' || substr(md5(c.conv_id || '-' || c.turn || '|7'), 1, 8))::bigint % n.n""")
def j12(spark, sf):
    conv = table(spark, sf, "conversations")
    resp = with_ordinal(conv.select(F.col("role").alias("intent"), F.col("text").alias("response"), "conv_id", "turn"),
                        ["conv_id", "turn"], ["intent"], name="pos")
    resp = resp.select("intent", (F.col("pos") - 1).alias("pos"), "response")
    pred = conv.select("conv_id", "turn", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"),
                       F.col("role").alias("intent"))
    return rel.attach_response(pred, resp, "key", seed=7).select("conv_id", "turn", "response")


# ---- sorts and limits -------------------------------------------------------

@query("T01_sort_by", "select event_id, cast(ts as varchar)[1:19] as at from events order by ts, event_id")
def t01(spark, sf):
    return rel.sort_by(table(spark, sf, "events"), ["ts", "event_id"]) \
        .select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("T02_sort_numeric", f"select user_id::varchar as u, movie_id::varchar as i, rating from {RATINGS}")
def t02(spark, sf):
    df = ratings(spark, sf).select(F.col("user_id").cast("string").alias("u"),
                                   F.col("movie_id").cast("string").alias("i"), "rating")
    return rel.sort_numeric(df, ["u", "i"])


@query("T03_head_tail", """
(select 'head' as part, event_id, value from events order by ts, event_id limit 10) union all
(select 'tail', event_id, value from events order by ts desc, event_id desc limit 10)""")
def t03(spark, sf):
    e = table(spark, sf, "events")
    a = rel.head(e, ["ts", "event_id"], 10).select(F.lit("head").alias("part"), "event_id", "value")
    return a.unionAll(rel.tail(e, ["ts", "event_id"], 10).select(F.lit("tail"), "event_id", "value"))


@query("T04_top_n", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 7")
def t04(spark, sf):
    return rel.top_n(table(spark, sf, "part"), "p_retailprice", 7, ["p_partkey"]).select("p_partkey", "p_retailprice")


@query("T09_limit_ordered", "select n_name from nation order by n_name limit 10")
def t09(spark, sf):
    return rel.head(table(spark, sf, "nation"), ["n_name"], 10).select("n_name")


# ---- set operations ---------------------------------------------------------

@query("U01_concat_rows", "select c_custkey as id, c_name as name from customer union all select s_suppkey, s_name from supplier")
def u01(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return rel.concat_rows(c, s)


@query("U02_set_union", "select l_partkey as id from lineitem union select p_partkey from part")
def u02(spark, sf):
    return rel.set_union(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")),
                         table(spark, sf, "part").select(F.col("p_partkey").alias("id")))


@query("U03_set_difference", "select o_orderkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem)")
def u03(spark, sf):
    return rel.set_difference(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                              table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])
