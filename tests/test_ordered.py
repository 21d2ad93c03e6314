"""Ordinals, running sums, fills and blocked windows, with hot groups and forced buckets."""

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from sparkloom.operators import ordered, relational as rel, windows as win
from sparkloom.operators.skew import dimension_join, fits_broadcast


@pytest.fixture(scope="module")
def rows(spark):
    """Group 'hot' holds most rows; values include nulls."""
    data = [("hot" if i % 3 else f"g{i % 7}", (i * 7919) % 1000, i, None if i % 4 == 0 else float(i % 13)) for i in range(1200)]
    return spark.createDataFrame(data, "g string, t int, id bigint, v double").cache()


def pandas_sorted(rows):
    return rows.toPandas().sort_values(["g", "t", "id"])


@pytest.mark.parametrize("buckets", [1, 2, 9])
def test_ordinal_per_group(rows, buckets):
    got = ordered.with_ordinal(rows, ["t", "id"], ["g"], buckets=buckets, total="n").toPandas().set_index("id")
    exp = pandas_sorted(rows)
    exp["rn"] = exp.groupby("g").cumcount() + 1
    exp = exp.set_index("id")
    assert (got["rn"].sort_index() == exp["rn"].sort_index()).all()
    assert (got["n"].sort_index() == exp.groupby("g")["rn"].transform("size").sort_index()).all()


@pytest.mark.parametrize("buckets", [1, 7])
def test_ordinal_overall(rows, buckets):
    got = ordered.with_ordinal(rows, ["t", "id"], buckets=buckets, total="n").toPandas()
    assert sorted(got["rn"]) == list(range(1, 1201)) and set(got["n"]) == {1200}
    assert got.sort_values("rn")[["t", "id"]].apply(tuple, axis=1).is_monotonic_increasing


def test_buckets_are_monotone_and_balanced(rows):
    b = ordered.with_bucket(rows, ["g", "t", "id"], 8).toPandas()
    assert b.sort_values(["g", "t", "id"])["__bucket"].is_monotonic_increasing
    sizes = b.groupby("__bucket").size()
    assert len(sizes) == 8 and sizes.max() < 4 * 1200 / 8


def test_running_sum_with_nulls_and_empty(spark, rows):
    got = win.cumsum(rows, "v", ["g"], ["t", "id"], "s").toPandas().set_index("id")["s"]
    ref = rows.withColumn("s", F.sum("v").over(Window.partitionBy("g").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
    exp = ref.toPandas().set_index("id")["s"]
    pd.testing.assert_series_equal(got.sort_index(), exp.sort_index(), check_exact=False)
    assert ordered.with_ordinal(rows.limit(0), ["t", "id"], ["g"]).count() == 0
    assert ordered.with_ordinal(rows.limit(0), ["t", "id"]).count() == 0


@pytest.mark.parametrize("buckets", [1, 6])
def test_next_known(rows, buckets):
    got = ordered.next_known(rows, ["v"], ["t", "id"], ["g"], buckets).toPandas().set_index("id")["v"]
    exp = pandas_sorted(rows)
    exp["v"] = exp.groupby("g")["v"].bfill()
    pd.testing.assert_series_equal(got.sort_index(), exp.set_index("id")["v"].sort_index())


def test_backfill_leaves_trailing_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None)], "t int, v double")
    assert [r.v for r in rel.backfill(df, ["v"], ["t"]).orderBy("t").collect()] == [5.0, 5.0, None]


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("buckets", [1, 5, 400])
def test_windows_over_borrowed_rows_equal_plain_ones(rows, by, buckets):
    """With 400 buckets most are shorter than the look-back, so rows are lent on over several buckets."""
    def build(w):
        return {"l": F.lag("id", 3).over(w), "m": F.avg("v").over(w.rowsBetween(-3, 0))}
    got = ordered.frame_windows(rows, build, ["t", "id"], by, 3, buckets=buckets)
    exp = rows.select("*", *[c.alias(n) for n, c in build(Window.partitionBy(*by).orderBy("t", "id")).items()])
    assert sorted(map(str, got.collect())) == sorted(map(str, exp.collect()))


def test_a_look_back_shuffles_rows_once(spark, rows):
    out = win.rolling(rows, "v", 10, ["g"], ["t", "id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan
    lent = ordered._lent_rows(ordered.with_bucket(rows, ["g", "t", "id"], bounds=(b := ordered.split_points(rows, ["g", "t", "id"], 9))), ["t", "id"], ["g"], 4, b)
    assert 0 < lent.count() <= 9 * 4


def test_windows_with_null_groups_and_no_rows(spark):
    df = spark.createDataFrame([(None if i % 2 else "a", i, float(i)) for i in range(200)], "g string, t int, v double")
    def build(w):
        return {"l": F.lag("v", 2).over(w)}
    got = ordered.frame_windows(df, build, ["t"], ["g"], 2, buckets=7)
    exp = df.select("*", F.lag("v", 2).over(Window.partitionBy("g").orderBy("t")).alias("l"))
    assert sorted(map(str, got.collect())) == sorted(map(str, exp.collect()))
    assert ordered.frame_windows(df.limit(0), build, ["t"], ["g"], 2).count() == 0


def test_rolling_is_null_until_full(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 4.0), (5, 6.0)], "t int, v double").withColumn("g", F.lit(1))
    out = win.rolling(df, "v", 2, ["g"], ["t"]).orderBy("t").collect()
    assert [r.v_mean2 for r in out] == [None, 1.5, None, None, 5.0]


def test_double_difference_and_inverse(spark):
    df = spark.createDataFrame([(i, float(i * i + 3)) for i in range(1, 9)], "t int, v double").withColumn("g", F.lit(1))
    out = win.diff(df, "v", ["g"], ["t"], (1, 2)).orderBy("t").collect()
    assert [r.v_diff2 for r in out] == [None, None] + [2.0] * 6
    logs = win.detrend(df, "v", 2, ["g"], ["t"], calendar=True)
    back = win.invert_diff(logs, "log_value", "log_diff", ["g"], ["t"]).collect()
    assert all(abs(r.restored - r.v) < 1e-9 for r in back)


def test_log_of_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "t int, v double").withColumn("g", F.lit(1))
    assert [r.log_value for r in win.detrend(df, "v", 2, ["g"], ["t"]).orderBy("t").collect()] == [None, 0.0]


def test_nth_row(rows):
    exp = rows.toPandas().sort_values(["t", "id"]).reset_index(drop=True)
    for n in (0, 17, 1199):
        assert rel.row_at(rows, ["t", "id"], n).first()["id"] == exp["id"][n]
    assert rel.row_at(rows, ["t", "id"], 1200).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_join_equals_plain_join(spark, how):
    fact = spark.createDataFrame([(None if i % 10 == 0 else (1 if i % 2 else i % 50), i) for i in range(2000)], "k int, x int")
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(40)], "k int, name string")
    plain = fact.join(dim, "k", how)
    for kw in ({}, {"probe": True}, {"hot_share": 0.001, "hot_floor": 100}, {"hot_share": 0.001, "hot_floor": 10_000}):
        got = dimension_join(fact, dim, "k", how, **kw)
        assert sorted(map(str, got.select("k", "x", "name").collect())) == sorted(map(str, plain.select("k", "x", "name").collect()))


def test_size_check_counts_rows_and_bytes(spark):
    df = spark.range(100).withColumn("s", F.lit("x" * 1000))
    assert fits_broadcast(df) and not fits_broadcast(df, max_rows=99) and not fits_broadcast(df, max_bytes=50_000)
