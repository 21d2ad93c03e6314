"""Ordered analytics over series: lags, differences, rolling and cumulative values."""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.operators.ordered import frame_windows, running_sums
from sparkloom.operators.relational import log_or_null
from sparkloom.operators.skew import dimension_join


def lag_col(df: DataFrame, col: str, n: int, by: list[str], order_by: list[str], name: str | None = None,
            calendar: bool = False) -> DataFrame:
    return frame_windows(df, lambda w: {name or f"{col}_lag{n}": F.lag(col, n).over(w)}, order_by, by, n, calendar)


def diff(df: DataFrame, col: str, by: list[str], order_by: list[str], times: int | tuple[int, ...] = 1,
         calendar: bool = False, name: str | None = None) -> DataFrame:
    """First, second, ... difference as alternating binomial sums of lags; several orders share one window."""
    orders = (times,) if isinstance(times, int) else times

    def build(w: Window) -> dict[str, Column]:
        out = {}
        for n in orders:
            terms = [(F.lag(col, k).over(w) if k else F.col(col)) * F.lit((-1) ** k * comb(n, k)) for k in range(n + 1)]
            out[name if name and len(orders) == 1 else f"{col}_diff{n}"] = reduce(lambda a, b: a + b, terms)
        return out

    return frame_windows(df, build, order_by, by, max(orders), calendar)


def rolling(df: DataFrame, col: str, width: int, by: list[str], order_by: list[str],
            fns: tuple[str, ...] = ("mean", "std"), calendar: bool = False) -> DataFrame:
    """Rolling mean / sample deviation; null until ``width`` known values are there."""
    kinds = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}

    def build(w: Window) -> dict[str, Column]:
        frame = w.rowsBetween(-(width - 1), 0)
        full = F.count(col).over(frame) == width
        return {f"{col}_{fn}{width}": F.when(full, kinds[fn](col).over(frame)) for fn in fns}

    return frame_windows(df, build, order_by, by, width - 1, calendar)


def cumsum(df: DataFrame, col: str, by: list[str], order_by: list[str], name: str | None = None) -> DataFrame:
    return running_sums(df, {name or f"{col}_cumsum": F.col(col)}, order_by, by)


def first_value(df: DataFrame, col: str, by: list[str], order_by: list[str], name: str | None = None) -> DataFrame:
    """Every row beside the first value of its group."""
    heads = df.groupBy(*by).agg(F.min_by(col, F.struct(*order_by)).alias(name or f"{col}_first"))
    return dimension_join(df, heads, by, derived=True)


def detrend(df: DataFrame, col: str, width: int, by: list[str], order_by: list[str], calendar: bool = False) -> DataFrame:
    """Log, log difference, and log minus its rolling mean. The log of zero is null."""
    logged = df.withColumn("log_value", log_or_null(F.col(col)))

    def build(w: Window) -> dict[str, Column]:
        frame = w.rowsBetween(-(width - 1), 0)
        mean = F.when(F.count("log_value").over(frame) == width, F.avg("log_value").over(frame))
        return {"log_diff": F.col("log_value") - F.lag("log_value", 1).over(w),
                "log_detrended": F.col("log_value") - mean}

    return frame_windows(logged, build, order_by, by, max(1, width - 1), calendar)


def invert_diff(df: DataFrame, base: str, predicted_diff: str, by: list[str], order_by: list[str]) -> DataFrame:
    """Undo a log difference: first log value plus cumulative predicted differences, then exp.

    ``base`` is the logged series; the whole part of the result is ``restored_int``.
    """
    steps = cumsum(df.withColumn("__d", F.coalesce(F.col(predicted_diff), F.lit(0.0))), "__d", by, order_by, "__sum")
    anchored = first_value(steps, base, by, order_by, "__first")
    value = F.exp(F.col("__first") + F.col("__sum"))
    return anchored.withColumns({"restored": value, "restored_int": value.cast("bigint")}).drop("__d", "__sum", "__first")
