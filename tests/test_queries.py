"""Every registered query against its SQL twin on the small tables, and plan checks."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    res = duck.execute(ORACLES[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


SCALED = ["P17_backfill", "M05_stratified_kfold", "M09_block_kfold", "M10_user_holdout", "M12_batch_ids", "W01_lag_events", "W02_diff",
          "W03_rolling", "W04_cumsum", "F01_label_encode", "X16_frequency_vocab", "T06_top_k_per_group", "J02_rating_user_item",
          "J08_similar_topk", "J13_rolling_origin", "G03_detect_sequence", "A17_auroc"]


@pytest.mark.parametrize("name", SCALED)
def test_no_single_task_window_or_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    assert not re.search(r"Window .*\n(?:.*\n){0,4}?.*SinglePartition", plan)


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = QUERIES["P06_filters"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(l_quantity,25.0)" in pushed and "l_returnflag" in pushed and "l_tax" not in plan
