"""Descriptive statistics, counts, histograms and calendar roll-ups."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.operators.quantile import quantile_values
from sparkloom.operators.skew import dimension_join


def melt(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Long form (column_name, value) of numeric columns, without a shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value"))
                      for c in cols])
    return df.select(*keep, F.inline(pairs))


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles in long form (column_name, p, value); columns without values are left out.

    Found by bracketing (``operators/quantile.py``): scans and counts, no sort and no exchange of the values.
    """
    found = quantile_values(df, cols, probs)
    rows = [(c, float(p), v) for (c, p), v in found.items() if v is not None]  # columns times probabilities
    return df.sparkSession.createDataFrame(rows, "column_name string, p double, value double")


def describe_table(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles and max: one row per column."""
    probs = [0.25, 0.5, 0.75]
    names = [F.col(f"`{c}`").cast("double") for c in cols]
    parts = {"count": F.count, "mean": F.mean, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[fn(x).alias(f"{n}{i}") for i, x in enumerate(names) for n, fn in parts.items()],
                  *([] if exact else [F.percentile_approx(x, probs).alias(f"q{i}") for i, x in enumerate(names)]))
    known = quantile_values(df, cols, probs) if exact else {}

    def quartile(i: int, at: int) -> Column:
        return F.lit(known[cols[i], probs[at]]).cast("double") if exact else F.col(f"q{i}")[at]

    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{n}{i}").alias(n) for n in ("count", "mean", "std", "min")],
                     *[quartile(i, at).alias(f"q{int(p * 100)}") for at, p in enumerate(probs)], F.col(f"max{i}").alias("max")) for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*rows)))


def trim_quantiles(df: DataFrame, col: str, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Rows strictly between two quantiles of the whole column."""
    bounds = quantile_values(df, [col], [lo, hi])
    if bounds[col, lo] is None:
        return df.limit(0)
    return df.filter((F.col(col) < bounds[col, hi]) & (F.col(col) > bounds[col, lo]))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), col)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def n_unique(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """Distinct non-null values of each column, long form."""
    if not exact:
        sums = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_unique"))
                                              for c in cols])))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in cols])
    seen = df.select(F.inline(pairs)).filter("v is not null").distinct()
    return seen.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))


PARTS = {"weekday": F.weekday, "quarter": F.quarter, "month": F.month, "year": F.year, "day": F.dayofmonth}


def group_calendar(df: DataFrame, ts: str, part: str, aggs: list[Column]) -> DataFrame:
    return df.groupBy(PARTS[part](F.col(ts)).alias(part)).agg(*aggs)


def collapse_rare(df: DataFrame, col: str, max_count: int, other: str = "OTHER") -> DataFrame:
    """Categories seen at most ``max_count`` times become ``other``; null stays null."""
    kept = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > max_count) \
        .select(col, F.lit(True).alias("__keep"))
    return dimension_join(df, kept, col, "left", derived=True) \
        .withColumn(col, F.when(F.col("__keep") | F.col(col).isNull(), F.col(col)).otherwise(F.lit(other))).drop("__keep")


def filter_frequent(df: DataFrame, col: str, min_count: int) -> DataFrame:
    """Rows whose category is seen more than ``min_count`` times."""
    kept = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > min_count).select(col)
    return dimension_join(df, kept, col, derived=True)


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlations in long form, all pairs of columns in one pass."""
    pairs = list(combinations_with_replacement(cols, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("corr")))
    return one.select(F.inline(F.array(*cells)))


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width counts; the last bin includes its right edge. Empty bins are left out."""
    key = by or "__all"
    src = df if by else df.withColumn(key, F.lit(0))
    src = src.select(key, F.col(col).cast("double").alias("__x")).filter("__x is not null")
    edges = src.groupBy(key).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    slot = F.least(F.floor((F.col("__x") - F.col("__lo")) / width), F.lit(bins - 1))
    out = (dimension_join(src, edges, key, derived=True)
           .withColumn("bin", F.when(width > 0, slot).otherwise(F.lit(0)).cast("int"))
           .groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"))
           .withColumn("left_edge", F.col("__lo") + F.col("bin") * width).drop("__lo", "__hi"))
    return out if by else out.drop(key)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


PERIODS = {"D": "day", "M": "month", "Q": "quarter", "Y": "year"}


def period_start(c: Column, freq: str) -> Column:
    return F.to_date(c) if freq == "D" else F.trunc(F.to_date(c), PERIODS[freq])


def period_end(start: Column, freq: str) -> Column:
    months = {"M": 1, "Q": 3, "Y": 12}
    return start if freq == "D" else F.date_sub(F.add_months(start, months[freq]), 1)


def resample(df: DataFrame, ts: str, freq: str, value: Column, keys: list[str] = (), name: str = "value",
             fill=0.0, label: str = "end") -> DataFrame:
    """Aggregate per calendar period; empty periods between a key's first and last get ``fill``.

    ``value`` is an aggregate such as ``F.sum("x")``. Each key has one row per
    period, so the calendar bounds the length of its series.
    """
    keys = list(keys)
    sums = df.groupBy(*keys, period_start(F.col(ts), freq).alias("__p")).agg(value.alias("__v"))
    months = {"M": 1, "Q": 3, "Y": 12}.get(freq)
    # Each period also writes the empty ones up to the next: no spine join, one pass over the rows.
    following = F.lead("__p").over(Window.partitionBy(*keys).orderBy("__p"))
    last = F.coalesce(F.date_sub(following, 1), F.col("__p"))
    step = F.expr(f"interval {months} months" if months else "interval 1 day")
    runs = sums.withColumn("__last", last).select("*", F.explode(F.sequence(F.col("__p"), F.col("__last"), step)).alias("period"))
    shown = F.col("period") if label == "start" else period_end(F.col("period"), freq)
    filled = F.when(F.col("period") == F.col("__p"), F.coalesce("__v", F.lit(fill))).otherwise(F.lit(fill))
    return runs.select(*keys, shown.alias("period"), filled.alias(name))


def epoch_rollup(df: DataFrame, epoch: str = "epoch", step: str = "step", metrics: list[str] = ("train_loss", "train_acc")) -> DataFrame:
    """Mean and last value of every step metric per epoch."""
    aggs = [f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.max_by(m, step).alias(f"{m}_last"))]
    return df.groupBy(epoch).agg(F.count(F.lit(1)).alias("steps"), *aggs)
