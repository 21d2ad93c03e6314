"""Paths, cycles and state machines over event sequences."""

from pyspark.sql import functions as F

from sparkloom.operators import graph as gr
from sparkloom.operators.windows import lag_col
from sparkloom.plans.registry import query, table
from sparkloom.runtime import cut_lineage

STEPS = """(select user_id, event_type as dst, coalesce(lag(event_type) over (partition by user_id order by ts, event_id), 'start') as src from events)"""
EDGES = f"""(select distinct src, dst from {STEPS} union
  select distinct arg_max(event_type, event_id) as src, 'end' as dst from events group by user_id)"""


def edges(spark, sf):
    """Event types that follow each other for some user, from 'start' to 'end'."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    steps = lag_col(e, "event_type", 1, ["user_id"], ["ts", "event_id"], "src")
    pairs = steps.select(F.coalesce("src", F.lit("start")).alias("src"), F.col("event_type").alias("dst"))
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("src")).select("src", F.lit("end").alias("dst"))
    return cut_lineage(pairs.unionByName(last).distinct())


@query("G01_all_paths", f"""
with recursive e as materialized (select * from {EDGES}), p as (
  select 0 as hops, ['start'] as path union all
  select hops + 1, list_append(path, dst) from p join e on e.src = path[len(path)]
  where hops < 5 and path[len(path)] <> 'end' and not list_contains(path, dst))
select hops, array_to_string(path, '>') as path from p where path[len(path)] = 'end'""")
def g01(spark, sf):
    return gr.all_paths(edges(spark, sf), "start", "end", 5).select("hops", F.array_join("path", ">").alias("path"))


REACH = f"""recursive e as materialized (select * from {EDGES}), r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst)"""


@query("G02_find_cycles", f"""with {REACH}
select a.src as vertex, least(a.src, min(b.dst)) as component from r a
join r b on b.src = a.src and exists (select 1 from r c where c.src = b.dst and c.dst = b.src) where a.src = a.dst group by a.src""")
def g02(spark, sf):
    return gr.find_cycles(edges(spark, sf))


@query("G02_has_cycle", f"with {REACH} select count(*) > 0 as has_cycle from r where src = dst")
def g02b(spark, sf):
    return gr.has_cycle(edges(spark, sf))


MOVES = [(gr.START, "view", "browse"), ("browse", "view", "browse"), ("browse", "click", "engaged"), ("engaged", "click", "engaged"),
         ("engaged", "purchase", "bought"), ("bought", "view", "browse"), ("engaged", "error", gr.START), ("browse", "error", gr.START)]
MOVES_SQL = "(values " + ", ".join(str(m) for m in MOVES) + ") m(state, input, next)"
RUN = f"""recursive s as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i from events),
 r as (select user_id, 0::bigint as i, -1::bigint as event_id, '{gr.START}' as state, false as matched, false as overlap from (select distinct user_id from events)
  union all select r.user_id, s.i, s.event_id, coalesce(m.next, r.state), m.next is not null, coalesce(m.next = r.state, false)
  from r join s on s.user_id = r.user_id and s.i = r.i + 1 left join {MOVES_SQL} on m.state = r.state and m.input = s.event_type)"""


def detected(spark, sf):
    moves = spark.createDataFrame(MOVES, "state string, input string, next string")
    return gr.detect_sequence(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", moves)


@query("G03_detect_sequence", f"with {RUN} select user_id, event_id, state, matched, overlap from r where i > 0")
def g03(spark, sf):
    return detected(spark, sf).select("user_id", "event_id", "state", "matched", "overlap")


@query("G03_sequence_summary", f"""with {RUN} select user_id, count(*) filter (matched) as length, arg_max(state, i) as state,
  bool_or(overlap) as overlapping from r where i > 0 group by 1""")
def g03b(spark, sf):
    return gr.sequence_summary(detected(spark, sf), ["user_id"], ["ts", "event_id"])
