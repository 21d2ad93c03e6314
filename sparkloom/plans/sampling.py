"""Shuffles, samples, splits, folds and batches."""

from pyspark.sql import functions as F

from sparkloom.operators import sampling as smp
from sparkloom.operators.aggregates import filter_frequent
from sparkloom.plans.joins import RATINGS, ratings
from sparkloom.plans.registry import query, table
from sparkloom.runtime import cut_lineage

ORD = "md5(o_orderkey || '|42')"
LABELLED = "(select d.doc_id, d.lang, l.quality from documents d join labels l using (doc_id))"


def labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("M01_shuffle", f"select o_orderkey, row_number() over (order by {ORD}, o_orderkey) as place from orders")
def m01(spark, sf):
    return smp.hash_ordinal(table(spark, sf, "orders"), "o_orderkey", 42, name="place").select("o_orderkey", "place")


@query("M01_shuffled_rows", f"select o_orderkey, o_totalprice from orders order by {ORD}")
def m01b(spark, sf):
    return smp.shuffle(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 42)


@query("M02_sample_n", f"select o_orderkey, o_totalprice from orders order by {ORD}, o_orderkey limit 100")
def m02(spark, sf):
    return smp.sample_n(table(spark, sf, "orders"), 100, "o_orderkey", 42).select("o_orderkey", "o_totalprice")


@query("M03_random_split", """
with u as (select o_orderkey, ('0x' || substr(md5(o_orderkey || '|7'), 1, 8))::bigint / 4294967296.0::double as u from orders)
select o_orderkey, case when u < 0.7 then 'train' else 'test' end as split from u""")
def m03(spark, sf):
    return smp.random_split(table(spark, sf, "orders"), {"train": 0.7, "test": 0.3}, "o_orderkey", 7).select("o_orderkey", "split")


@query("M04_stratified_split", f"""
with r as (select doc_id, quality, row_number() over (partition by quality order by md5(doc_id || '|3'), doc_id) as rn,
             count(*) over (partition by quality) as n from {LABELLED})
select doc_id, quality, case when rn <= floor(n * 0.2::double + 0.5) then 'test' else 'train' end as split from r""")
def m04(spark, sf):
    return smp.stratified_split(labelled(spark, sf), "quality", 0.2, "doc_id", 3).select("doc_id", "quality", "split")


KFOLD = f"""select doc_id, quality, ((row_number() over (partition by quality order by md5(doc_id || '|11'), doc_id) - 1) % 5)::int as kfold
from {LABELLED}"""


@query("M05_stratified_kfold", KFOLD)
def m05(spark, sf):
    return smp.stratified_kfold(labelled(spark, sf), "quality", 5, "doc_id", 11).select("doc_id", "quality", "kfold")


@query("M06_fold_split", f"select doc_id, quality, case when kfold = 0 then 'valid' else 'train' end as part from ({KFOLD})")
def m06(spark, sf):
    train, valid = smp.fold_split(cut_lineage(m05(spark, sf)), 0)  # the stored fold table
    return train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))


@query("M07_band_split", f"""
with r as (select o_orderkey, row_number() over (order by md5(o_orderkey || '|5'), o_orderkey) as rn, count(*) over () as n from orders)
select o_orderkey, case when rn <= n * 7 // 10 then 'train' when rn <= n * 7 // 10 + n // 11 then 'val' else 'test' end as split
from r""")
def m07(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    n = o.count()
    return smp.band_split(o, {"train": n * 7 // 10, "val": n // 11, "test": n // 13}, "o_orderkey", 5)


@query("M08_head_tail_split", """
with d as (select cast(o_orderdate as date) as d, count(*) as n from orders group by 1),
 r as (select d, n, row_number() over (order by d) as rn, count(*) over () as total from d)
select d::varchar as day, n, case when rn <= floor(total * 0.8::double) then 'train' else 'test' end as ratio_split,
  case when rn <= total - 12 then 'train' else 'test' end as tail_split from r""")
def m08(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    out = smp.head_tail_split(d, ["d"], ratio=0.8, name="ratio_split")
    out = smp.head_tail_split(out, ["d"], tail=12, name="tail_split")
    return out.select(F.col("d").cast("string").alias("day"), "n", "ratio_split", "tail_split")


FILE_ORDER = "l_orderkey, l_linenumber, movie_id, rating"


@query("M09_block_kfold", f"""
select user_id, movie_id, rating, l_orderkey, l_linenumber, ntile(5) over (order by {FILE_ORDER})::int as fold from {RATINGS}""")
def m09(spark, sf):
    joined = cut_lineage(ratings(spark, sf))  # a join, read three times: for split points, totals and rows
    return smp.block_kfold(joined, ["l_orderkey", "l_linenumber", "movie_id", "rating"], 5)


@query("M10_user_holdout", """
with r as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as rn, ts from events)
select event_id, user_id, case when rn between 1 and 10 then 'test' else 'base' end as split from r""")
def m10(spark, sf):
    return smp.user_holdout(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 1, 10).select("event_id", "user_id", "split")


@query("M10_user_holdout_capped", """
with r as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) between 11 and 20 as pick from events),
 c as (select *, sum(pick::int) over (order by ts, event_id rows unbounded preceding) as seen from r)
select event_id, user_id, case when pick and seen <= 500 then 'test' else 'base' end as split from c""")
def m10b(spark, sf):
    return smp.user_holdout(table(spark, sf, "events"), "user_id", ["ts", "event_id"], 11, 20, 500) \
        .select("event_id", "user_id", "split")


@query("M11_filter_frequent", """
select o_orderkey, o_custkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) > 9)""")
def m11(spark, sf):
    return filter_frequent(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 9)


@query("M12_batch_ids", """
with r as (select event_id, row_number() over (order by ts, event_id) - 1 as pos, count(*) over () as n from events)
select event_id, pos // 64 as batch from r where pos // 64 < n // 64""")
def m12(spark, sf):
    return smp.batch_ids(table(spark, sf, "events"), ["ts", "event_id"], 64, drop_last=True).select("event_id", "batch")
