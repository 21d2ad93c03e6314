"""Scans, exports and date spines (S01-S16): written to shared scratch and read back."""

from pyspark.sql import functions as F

from sparkloom.plans.registry import query, table
from sparkloom.runtime import scratch_path
from sparkloom.sources import files
from sparkloom.sources.tables import SCHEMAS


@query("S01_read_csv", "select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def s01(spark, sf):
    path = scratch_path(spark, "customer")
    files.write_csv(table(spark, sf, "customer"), path)
    df = files.read_csv(spark, path)
    return df.select(F.col("c_custkey").cast("bigint"), "c_name", "c_acctbal", "c_mktsegment")


@query("S02_read_delimited", "select s_suppkey as id, s_name as name, s_nationkey as nation, "
       "s_acctbal as balance from supplier")
def s02(spark, sf):
    path = scratch_path(spark, "supplier")
    (table(spark, sf, "supplier").write.option("sep", "|").option("encoding", "ISO-8859-1")
     .option("header", False).csv(path))
    df = files.read_delimited(spark, path, "|", ["id", "name", "nation", "balance"], encoding="ISO-8859-1")
    return df.withColumn("id", F.col("id").cast("bigint"))


@query("S03_parse_dates", "select o_orderkey, cast(cast(o_orderdate as date) as varchar) as order_date, "
       "year(o_orderdate)::int as order_year from orders")
def s03(spark, sf):
    path = scratch_path(spark, "orders")
    files.write_csv(table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_orderdate")), path)
    df = files.read_csv(spark, path, schema="o_orderkey bigint, o_orderdate string",
                        parse_dates={"o_orderdate": "dd/MM/yyyy"})
    return df.select("o_orderkey", F.col("o_orderdate").cast("string").alias("order_date"),
                     F.year("o_orderdate").alias("order_year"))


@query("S04_usecols", "select l_returnflag, count(*) as n, cast(sum(l_quantity) as double) as qty "
       "from lineitem group by 1")
def s04(spark, sf):
    path = scratch_path(spark, "lineitem")
    files.write_csv(table(spark, sf, "lineitem").drop("l_shipdate"), path)
    schema = SCHEMAS["lineitem"].replace(", l_shipdate timestamp_ntz", "")
    df = files.read_csv(spark, path, schema=schema, usecols=["l_returnflag", "l_quantity"])
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("S05_nrows", "select event_id, event_type, value from events order by ts, event_id limit 100")
def s05(spark, sf):
    path = scratch_path(spark, "events")
    files.write_csv(table(spark, sf, "events"), path)
    df = files.read_csv(spark, path, schema=SCHEMAS["events"], order_by=["ts", "event_id"], nrows=100)
    return df.select("event_id", "event_type", "value")


@query("S06_read_dataset", "select d.text, l.quality as label from documents d join labels l using (doc_id)")
def s06(spark, sf):
    path = scratch_path(spark, "reviews") + ".json"
    table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id") \
        .select(F.col("text").alias("review"), F.col("quality").alias("target")).write.json(path)
    return files.read_dataset(spark, path, "review", "target", schema="review string, target int")


@query("S07_load_intents", """
select role as intent, unnest(string_split(text, chr(10))) as text, conv_id::varchar as response
from conversations""")
def s07(spark, sf):
    path = scratch_path(spark, "intents")
    record = F.struct(F.col("role").alias("intent"), F.split("text", "\n").alias("text"),
                      F.array(F.col("conv_id").cast("string")).alias("responses"))
    table(spark, sf, "conversations").select(F.array(record).alias("intents")).write.json(path)
    return files.load_intents(spark, path, multi_line=False) \
        .select("intent", "text", F.col("responses")[0].alias("response"))


@query("S08_read_text_tree", """
select case when d.doc_id % 2 = 0 then 'train' else 'test' end as split, l.quality as label,
       rtrim(d.text, chr(10)) as text
from documents d join labels l using (doc_id)""")
def s08(spark, sf):
    path = scratch_path(spark, "tree")
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    kind = F.when(F.col("quality") == 1, "pos").otherwise("neg")
    part = F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test")
    # Partition folders give one file per document: split=<s>/kind=<k>/doc_id=<id>/part.
    (docs.select("text", part.alias("split"), kind.alias("kind"), "doc_id")
     .write.partitionBy("split", "kind", "doc_id").text(path))
    tree = files.read_text_tree(spark, path, {"split=train": "train", "split=test": "test"},
                                {"kind=pos": 1, "kind=neg": 0})
    return tree.select("split", "label", F.rtrim(F.col("text"), F.lit("\n")).alias("text"))


@query("S09_read_text", """
select line, count(*) as n from (
  select unnest(string_split(text, chr(10))) as line from documents) group by line""")
def s09(spark, sf):
    path = scratch_path(spark, "lines")
    table(spark, sf, "documents").select("text").write.text(path)
    return files.read_text(spark, path).groupBy(F.col("text").alias("line")).agg(F.count("*").alias("n"))


@query("S10_write_csv", "select * from part")
def s10(spark, sf):
    path = scratch_path(spark, "part")
    files.write_csv(table(spark, sf, "part"), path)
    return files.read_csv(spark, path, schema=SCHEMAS["part"])


@query("S11_export_csv", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def s11(spark, sf):
    path = scratch_path(spark, "export")
    files.export_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return files.read_delimited(spark, path, ";", header=True,
                                schema="o_orderkey bigint, o_orderstatus string, o_totalprice double")


HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"


@query("S12_external_table", f"select {HOST_SQL} as hostname, count(*) as n from pages group by 1")
def s12(spark, sf):
    path = scratch_path(spark, "hosts")
    hosts = table(spark, sf, "pages").select(F.expr("parse_url(url, 'HOST')").alias("hostname"))
    files.write_csv(hosts, path)
    files.external_csv_table(spark, "hosts_external", path, "hostname string")
    return spark.sql("select hostname, count(*) as n from hosts_external group by hostname")


@query("S13_save_dataset", "select doc_id, lang, n_chars from documents")
def s13(spark, sf):
    path = scratch_path(spark, "dataset")
    files.save_dataset(table(spark, sf, "documents"), path, ["doc_id", "lang", "n_chars"])
    return files.load_dataset(spark, path)


@query("S14_save_mapping", "select (row_number() over (order by event_type) - 1)::bigint as id, "
       "event_type as name from (select distinct event_type from events)")
def s14(spark, sf):
    from sparkloom.operators.ordered import with_ordinal
    path = scratch_path(spark, "mapping")
    classes = with_ordinal(table(spark, sf, "events").select(F.col("event_type").alias("name")).distinct(),
                           ["name"], name="id")
    files.save_mapping(classes.withColumn("id", F.col("id") - 1), path)
    return files.load_mapping(spark, path, "id bigint, name string")


@query("S15_write_splits", """
select case o_orderstatus when 'F' then 'train' when 'O' then 'val' else 'test' end as split,
       count(*) as n, min(o_orderkey) as first_key from orders group by 1""")
def s15(spark, sf):
    path = scratch_path(spark, "splits")
    status = F.col("o_orderstatus")
    split = F.when(status == "F", "train").when(status == "O", "val").otherwise("test")
    files.write_splits(table(spark, sf, "orders").withColumn("split", split), path)
    parts = [files.read_split(spark, path, s) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("S16_date_spine", """
with b as (select o_orderpriority as priority, min(o_orderdate)::date as lo, max(o_orderdate)::date as hi
           from orders group by 1)
select priority, 'D' as freq, cast(cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as varchar) as day from b
union all
select priority, 'MS', cast(cast(d as date) as varchar) from (
  select priority, lo, unnest(generate_series(date_trunc('month', lo), hi, interval 1 month)) as d from b) where d >= lo""")
def s16(spark, sf):
    b = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    out = [files.date_spine(b, "lo", "hi", f, "day").select("priority", F.lit(f).alias("freq"),
                                                            F.col("day").cast("string").alias("day"))
           for f in ("D", "MS")]
    return out[0].unionByName(out[1])
