"""Registry of queries with their SQL twins, and rounding shared by both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rnd(c: Column | str, digits: int = 4) -> Column:
    """Round to ``digits``; the boundary lies off exact halves so engines agree."""
    c = F.col(c) if isinstance(c, str) else c
    k = float(10 ** digits)
    return F.floor(c * F.lit(k) + F.lit(0.50013)) / F.lit(k)


def rnd_sql(expr: str, digits: int = 4) -> str:
    return f"(floor(cast({expr} as double) * 1e{digits} + 0.50013::double) / 1e{digits})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from sparkloom.sources.tables import load
    return load(spark, sf_dir, name)
