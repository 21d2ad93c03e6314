"""Size checks before a broadcast, and joins that split hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.runtime import cut_lineage

MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 << 20


def _row_bytes(df: DataFrame):
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + 16)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            parts.append(F.greatest(F.size(c), F.lit(0)) * 8 + 16)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16)
        else:
            parts.append(F.lit(8))
    return reduce(lambda a, b: a + b, parts)


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                   max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes; no more than ``max_rows`` + 1 rows of it are read."""
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return n <= max_rows and (size or 0) <= max_bytes


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.001,
             floor: int = 100_000) -> DataFrame:
    """Keys holding more than ``share`` of all rows: at most ``1 / share`` of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    limit = max(floor, int((total.first()[0] or 0) * share))
    return counts.filter(F.col("__n") > limit).select(*keys)


def dimension_join(fact: DataFrame, dim: DataFrame, on: list[str] | str,
                   how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS,
                   max_bytes: int = MAX_BROADCAST_BYTES, hot_share: float | None = None,
                   hot_floor: int = 100_000, derived: bool = False, probe: bool = False) -> DataFrame:
    """Join a fact to a dimension whose key is unique.

    By default a plain join, no job before it: file statistics decide on a broadcast, and adaptive
    execution splits skewed partitions. With ``probe`` a dimension found small by a bounded read is broadcast,
    so the fact is not shuffled; ``derived`` dimensions (aggregates of a large table) are stored first and then
    probed. With ``hot_share`` rows of keys above that share of all rows meet the few dimension rows
    they need by a broadcast of proven size, and the others take the plain join.
    """
    on = [on] if isinstance(on, str) else list(on)
    if derived:
        dim = cut_lineage(dim)
    if (derived or probe) and fits_broadcast(dim, max_rows, max_bytes):
        return fact.join(F.broadcast(dim), on, how)
    if hot_share is None:
        return fact.join(dim, on, how)
    hot = hot_keys(fact, on, hot_share, hot_floor)
    is_hot = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    tagged = fact.join(is_hot, on, "left")
    cold = tagged.filter(F.col("__hot").isNull()).drop("__hot").join(dim, on, how)
    warm_dim = dim.join(F.broadcast(hot), on, "left_semi")
    warm = tagged.filter(F.col("__hot")).drop("__hot").join(F.broadcast(warm_dim), on, how)
    if how == "left":
        # Null keys match nothing and would all land in one partition of a shuffle join.
        lost = F.lit(False)
        for c in on:
            lost = lost | F.col(c).isNull()
        rest = fact.filter(lost).join(F.broadcast(dim.limit(0)), on, "left")
        return cold.filter(~lost).unionByName(warm).unionByName(rest)
    return cold.unionByName(warm)
